"""Free-text search over a posting table of trigrams.

An index is a folder of three tables. ``members`` has the rows' texts, lower case, a row for each
distinct text of an id; ``texts`` has each distinct text once, with a key; ``grams`` is sorted by gram:
(gram, bucket, places), a place being a text's key and where in it the gram begins. So a text that
many rows have is cut to grams once. Texts are dealt to buckets of about ``BUCKET_ROWS``, so that a gram
of every text is many postings of a bounded size. Two marks end each text, so the last characters
begin grams too, and a needle shorter than a gram is found by the grams that begin with it.

``find`` reads the postings of a needle's grams, the filter being pushed down to files sorted by it,
and takes the texts in which they stand at their distances. Keys are hashes: the texts found are
compared with the needle, so two texts of one key are told apart. Their members are the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.session import cut

GRAM, BUCKET_ROWS = 3, 20_000
MARK = "\x1f"


def texts_of(columns: list[str]) -> Column:
    return F.filter(F.array_distinct(F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in columns))), lambda t: t != "")


def write_index(rows: DataFrame, id_column: str, columns: list[str], path: str) -> None:
    """Index ``columns`` of ``rows`` under ``path``. Null texts are empty; a null id is a row like
    others, ids that repeat are one row."""
    spark = rows.sparkSession
    rows.select(F.col(id_column).alias("id"), F.explode(texts_of(columns)).alias("text")).write.mode("overwrite").parquet(f"{path}/members")
    texts = cut(spark.read.parquet(f"{path}/members").select("text").distinct().select(F.xxhash64("text").alias("key"), "text"))
    texts.write.mode("overwrite").parquet(f"{path}/texts")
    buckets = max(1, -(-texts.count() // BUCKET_ROWS))
    padded = F.concat("text", F.lit(MARK * (GRAM - 1)))
    spots = F.explode(F.sequence(F.lit(1), F.length("text")))
    grams = texts.select("key", padded.alias("text"), spots.alias("at")).select("key", "at", F.substring("text", F.col("at"), F.lit(GRAM)).alias("gram"))
    postings = grams.where(~F.startswith("gram", F.lit(MARK))).groupBy("gram", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("key", "at"))).alias("places"))
    postings.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.mode("overwrite").parquet(f"{path}/grams")


def offsets(needle: str) -> dict[str, list[int]]:
    """The grams of a needle that cover it, and where in it they begin."""
    starts = sorted({*range(0, len(needle) - GRAM + 1, GRAM), len(needle) - GRAM})
    out: dict[str, list[int]] = {}
    for k in starts:
        out.setdefault(needle[k : k + GRAM], []).append(k)
    return out


def _texts(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(text) of the distinct texts that have ``needle``, which is in lower case."""
    index = spark.read.parquet(f"{path}/grams")
    if MARK in needle:
        keys = index.where(F.lit(False)).select(F.explode("places").alias("p")).select("p.key")
    elif len(needle) < GRAM:
        keys = index.where(F.startswith("gram", F.lit(needle))).select(F.explode("places").alias("p")).select("p.key").distinct()
    else:
        grams = offsets(needle)
        wanted = sum(map(len, grams.values()))
        at = F.create_map(*(x for g, ks in grams.items() for x in (F.lit(g), F.array(*map(F.lit, ks)))))[F.col("gram")]
        met = index.where(F.col("gram").isin(list(grams))).select(F.explode("places").alias("p"), at.alias("ks")).select("p.key", "p.at", F.explode("ks").alias("k"))
        # a place and distance occurs once a text, so a count tells whether all are there
        keys = met.groupBy("key", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select("key").distinct()
    return spark.read.parquet(f"{path}/texts").join(keys, "key").where(F.contains("text", F.lit(needle))).select("text")


def find_all(spark: SparkSession, path: str, needles: list[str]) -> DataFrame:
    """(needle, id) of the rows that have each of ``needles`` in a column, whatever its case. An empty
    needle is in every row that has a character; one with the mark is in none. Members are read
    once for all needles."""
    found = reduce(DataFrame.union, [_texts(spark, path, n.lower()).select(F.lit(n).alias("needle"), "text") for n in needles])
    by_text = found.groupBy("text").agg(F.collect_set("needle").alias("needles"))
    met = spark.read.parquet(f"{path}/members").join(by_text, "text")
    return met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("needles"))).alias("needles")).select(F.explode("needles").alias("needle"), "id")


def find(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(id) of the rows that have ``needle`` in a column."""
    return find_all(spark, path, [needle]).select("id")
