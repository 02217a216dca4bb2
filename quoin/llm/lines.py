"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared by their words: lower case, letters and digits, one blank between. A line
is dropped where an earlier line of the corpus, by place, has the same words, or is within one
edit: one unit put in, left out or replaced. Units are words in lines of ``near_words`` words
and more, else characters, if there are ``near_chars`` of them. So one word in eight may
differ, and in short lines, or lines of a script without blanks, one letter. Lines of one kind
of units are not held against those of the other, shorter ones are judged for equality only,
and lines of fewer than ``least_words`` words are never judged and stay.

1. Lines shrink to distinct word sequences, each with its earliest place.
2. Two sequences within one edit share their first or their last half. Those that share
   neither with any other drop out before variants are made.
3. The rest emit their deletion variants as hashed keys: each unit left out, once with its
   place (equal keys: one unit replaced) and once without (equal to a whole sequence: one unit
   put in). Equal keys form a group whose earliest member is the witness of the others, so a
   group of any size makes as many links as it has members, never pairs.
4. The edit distance of each line and its witness is verified on the sequences themselves.

A place is (doc_id, hash of the row's text, line number), so rows of one doc_id with unlike
texts are judged one by one, in the order of their hashes. Rows that repeat doc_id and text
count as one: their lines stay or go together. Null and empty texts have one empty line, which
stays. A row without doc_id is returned as it is and takes no part. A document keeps its row
even if all its lines go; then its text is empty. Texts and lines of any length are judged whole;
a table without rows gives none. Columns beside the text are carried along, but for those named as
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import guarded, read, text_or_empty, written

LEAST_WORDS, NEAR_WORDS, NEAR_CHARS = 1, 8, 12
PLACE = ["doc_id", "row", "line_no"]


def line_words(line: Column) -> Column:
    """The words of a line, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def row_of(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def first_units(k: str) -> str:
    """SQL for the first ``k`` units of ``joined``; ``letters`` says whether those are characters."""
    return f"CASE WHEN letters THEN substring(joined, 1, {k}) ELSE substring_index(joined, ' ', {k}) END"


def last_units(k: str) -> str:
    return f"CASE WHEN letters THEN right(joined, {k}) ELSE substring_index(joined, ' ', -({k})) END"


def half(units: str, tag: str) -> Column:
    """Key of a half of ``joined``, unlike for words and characters."""
    return F.expr(f"xxhash64({units}, letters, '{tag}')")


def keyed_lines(docs: DataFrame, text: str, least_words: int, near_words: int, near_chars: int) -> DataFrame:
    """Every line's place and the hashed keys of its words and of their halves."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", row_of(text).alias("row"), F.posexplode(F.split(text_or_empty(text), "\n")).alias("line_no", "line"))
    words = lines.select(*PLACE, line_words(F.col("line")).alias("joined"))
    blanks = F.octet_length("joined") - F.octet_length(F.replace("joined", F.lit(" "), F.lit("")))
    counted = words.withColumn("words", F.when(F.col("joined") == "", 0).otherwise(blanks + 1))
    sized = counted.withColumn("letters", F.col("words") < near_words).withColumn("n", F.when(F.col("letters"), F.length("joined")).otherwise(F.col("words")))
    judged = F.col("words") >= least_words
    # a line of 2k units has halves of k and of k - 1 units, one of 2k + 1 units those of k
    near = judged & (~F.col("letters") | (F.col("n") >= near_chars))
    even = near & (F.col("n") % 2 == 0)
    return sized.select(
        judged.alias("judged"),
        F.when(judged, F.xxhash64("joined")).otherwise(F.col("doc_id")).alias("h1"),
        F.when(judged, F.xxhash64(F.concat(F.lit("~"), "joined"))).otherwise(F.xxhash64("row", "line_no")).alias("h2"),
        F.struct(*PLACE).alias("at"),
        F.when(near, half(first_units("n div 2"), "first")).alias("p1"),
        F.when(even, half(first_units("n div 2 - 1"), "first")).alias("p2"),
        F.when(near, half(last_units("n div 2"), "last")).alias("s1"),
        F.when(even, half(last_units("n div 2 - 1"), "last")).alias("s2"),
        "letters",
    )


def distinct_lines(keyed: DataFrame) -> DataFrame:
    told = ["p1", "p2", "s1", "s2", "letters"]
    return keyed.groupBy("judged", "h1", "h2").agg(F.min("at").alias("at"), *(F.max(c).alias(c) for c in told)).select("at.*", "judged", *told)


def sharing(distinct: DataFrame) -> DataFrame:
    """Places of distinct lines that share a half with another, and which halves they share."""
    halves = distinct.where("p1 IS NOT NULL").select(*PLACE, "letters", F.explode(F.expr("array_distinct(array(struct(true AS head, p1 AS half), struct(true AS head, p2 AS half), struct(false AS head, s1 AS half), struct(false AS head, s2 AS half)))")).alias("_h"))
    halves = halves.select(*PLACE, "letters", "_h.head", "_h.half").where("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    return halves.join(shared, "half").groupBy(*PLACE, "letters").agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail"))


def near_duplicates(docs: DataFrame, distinct: DataFrame, text: str) -> DataFrame:
    """Places of the distinct lines that an earlier one within one edit makes superfluous."""
    wanted = sharing(distinct).groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "letters", "head", "tail")).alias("wanted"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", row_of(text).alias("row"), F.split(text_or_empty(text), "\n").alias("lines"))
    chosen = texts.join(wanted, ["doc_id", "row"]).select("doc_id", "row", F.explode(F.expr("transform(wanted, w -> struct(w.line_no AS line_no, w.letters AS letters, w.head AS head, w.tail AS tail, get(lines, w.line_no) AS line))")).alias("_l"))
    # rows that repeat doc_id and text give equal lines
    once = chosen.select(F.struct("doc_id", "row", "_l.line_no").alias("at"), "_l.letters", "_l.head", "_l.tail", line_words(F.col("_l.line")).alias("joined")).distinct()
    lines = written(once.withColumn("n", F.when(F.col("letters"), F.length("joined")).otherwise(F.size(F.split("joined", " ")))))

    # a shared first half leaves the edit to the places behind it, a shared last half to those before;
    # a variant is hashed as soon as it is made, so a line holds two numbers for each of its units
    left_out = f"""CASE WHEN letters THEN concat(left(joined, i), right(joined, n - 1 - i))
                        ELSE trim(concat({first_units("i")}, ' ', {last_units("n - 1 - i")})) END"""
    variants = written(
        lines.select(
            "at",
            F.explode(
                F.expr(f"""
                concat(
                  array(struct(xxhash64(joined, letters, -1) AS key, true AS whole)),
                  flatten(transform(
                    transform(
                      filter(sequence(0, n - 1), i -> (head AND i >= (n - 1) div 2 - 1) OR (tail AND i <= n div 2 + 1)),
                      i -> struct(i, xxhash64({left_out}, letters, -1) AS v)),
                    x -> array(struct(xxhash64(x.v, x.i, n) AS key, false AS whole), struct(x.v AS key, false AS whole)))))
                """)
            ).alias("_v"),
        ).select("at", "_v.key", "_v.whole")
    )
    groups = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min(F.when(F.col("whole"), F.col("at"))).alias("whole_at"))
    groups = groups.where("n > 1")
    met = variants.join(groups, "key")
    # a sequence put in or left out is linked with the whole one; replaced words link with the earliest
    witness = F.when(F.col("whole_at").isNull(), F.col("first")).when(F.col("whole"), F.col("first")).otherwise(F.col("whole_at"))
    links = met.select("at", witness.alias("by")).where("by < at").distinct()
    a = lines.select("at", "letters", F.split("joined", " ").alias("mine"))
    b = lines.select(F.col("at").alias("by"), F.split("joined", " ").alias("other"))
    close = F.when(F.col("letters"), F.levenshtein(F.array_join("mine", " "), F.array_join("other", " "), 1) >= 0).otherwise(within_one_edit("mine", "other"))
    return links.join(a, "at").join(b, "by").where(close).select("at").distinct().select("at.*")


def within_one_edit(a: str, b: str) -> Column:
    """Whether two word arrays differ by one word put in, left out or replaced, or not at all."""
    return F.expr(f"""
        CASE WHEN size({a}) = size({b}) THEN size(filter(zip_with({a}, {b}, (x, y) -> x <=> y), same -> NOT same)) <= 1
             WHEN size({a}) = size({b}) + 1 THEN {_left_out(a, b)}
             WHEN size({b}) = size({a}) + 1 THEN {_left_out(b, a)}
             ELSE false END""")


def _left_out(long: str, short: str) -> str:
    same = f"coalesce(nullif(array_position(zip_with({short}, {long}, (x, y) -> x <=> y), false), 0) - 1, size({short}))"
    # zip_with pads the shorter array with null, which differs, so a difference is always found
    return f"concat(slice({long}, 1, cast({same} AS int)), slice({long}, cast({same} AS int) + 2, size({long}))) = {short}"


def dedup(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and ``n_lines``, ``n_dropped``, ``n_near``,
    ``n_judged``: lines, lines dropped, those of them dropped for a near duplicate, and lines
    that were compared at all."""
    plain = docs.select("doc_id", text)
    distinct = written(distinct_lines(keyed_lines(plain, text, least_words, near_words, near_chars)))
    near = near_duplicates(plain, distinct, text).withColumn("near", F.lit(True))
    verdicts = distinct.select(*PLACE, "judged").join(near, PLACE, "left")
    kept = verdicts.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.when(F.col("near").isNull(), F.col("line_no")))).alias("_kept"), F.count("near").alias("_near"), F.count_if(F.col("near").isNull() & F.col("judged")).alias("_new"))
    own, back = guarded(docs, [text, "n_lines", "n_dropped", "n_near", "n_judged"])
    split = docs.select(*own, F.col("doc_id").alias("_doc"), row_of(text).alias("_row"), F.split(text_or_empty(text), "\n").alias("_lines"))
    joined = split.join(kept, ["_doc", "_row"], "left")
    # a line that an equal one on the same row's document keeps elsewhere is not in _kept
    stays = F.expr("transform(_kept, i -> get(_lines, i))")
    whole = F.col("_doc").isNull()
    dropped = F.when(whole, 0).otherwise(F.size("_lines") - F.coalesce(F.size("_kept"), F.lit(0))).cast("long")
    out = joined.select(
        *back,
        F.when(whole, F.array_join("_lines", "\n")).otherwise(F.coalesce(F.array_join(stays, "\n"), F.lit(""))).alias(text),
        F.size("_lines").cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
        (dropped + F.coalesce("_new", F.lit(0))).alias("n_judged"),
    )
    order = [c for c in docs.columns if c in out.columns]
    return out.select(*order, "n_lines", "n_dropped", "n_near", "n_judged")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, lines dropped, and the digest of the text that is left."""
    rows = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM split
), worded AS (
  SELECT doc_id, line_no, line, trim(regexp_replace(lower(line), '[^\pL\pN]+', ' ', 'g')) AS joined FROM line
), counted AS (
  SELECT *, CASE WHEN joined = '' THEN 0 ELSE len(string_split(joined, ' ')) END AS n FROM worded
), ranked AS (
  SELECT *, n < 1 OR row_number() OVER (PARTITION BY joined ORDER BY doc_id, line_no) = 1 AS is_first FROM counted
), dist AS (
  SELECT joined, (doc_id, line_no) AS pos, n < 8 AS letters, CASE WHEN n < 8 THEN string_split(joined, '') ELSE string_split(joined, ' ') END AS units
  FROM ranked WHERE is_first AND (n >= 8 OR n >= 1 AND length(joined) >= 12)
), place AS (
  SELECT *, len(units) AS n, unnest(range(len(units))) AS i FROM dist
), variant AS (
  SELECT pos, letters, n, i, CASE WHEN letters THEN array_to_string(list_concat(units[:i], units[i + 2:]), '') ELSE array_to_string(list_concat(units[:i], units[i + 2:]), ' ') END AS v FROM place
), replaced AS (
  SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY letters, n, i, v) AS first FROM variant) WHERE first < pos
), put_in AS (
  SELECT greatest(v.pos, d.pos) AS pos FROM variant v JOIN dist d ON d.joined = v.v AND d.letters = v.letters
), near AS (
  SELECT DISTINCT pos FROM (SELECT pos FROM replaced UNION ALL SELECT pos FROM put_in)
), verdict AS (
  SELECT r.doc_id, r.line_no, r.line, r.is_first AND n.pos IS NULL AS stays, r.is_first AND n.pos IS NOT NULL AS is_near
  FROM ranked r LEFT JOIN near n ON n.pos = (r.doc_id, r.line_no)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, count(*) FILTER (is_near) AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '')) AS text_sha256
FROM verdict GROUP BY doc_id
"""
