"""The corpus pipeline: quality, line dedup, near duplicates, benchmark leaks, tokens.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir), where docs
has the columns of ``documents``, and returns a DataFrame of what its stage keeps; all but the
last return the columns of ``documents``. ``run`` applies them to ``documents``, each stage's
result written as Parquet in the shared folder and read again as the next one's input.

Nulls, empty texts, repeated rows and extra columns are handled as the operators' own notes
say. Line dedup judges every line that has a letter or digit. A document of which no such line
is left is dropped there, as all it says is said by earlier ones, whatever blank lines it has;
documents without such a line before stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import bpe, hyperminhash, leaks, lines, quality
from quoin.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``; n_chars follows the text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled rows of ``docs``."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated lines taken out; those with no other lines go."""
    rows = lines.dedup(docs)
    return _documents(rows.where("n_dropped = 0 OR n_dropped < n_judged"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8."""
    return hyperminhash.dedup(docs, words=5, percent=80).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item lies."""
    return leaks.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their count, and the digest of what they decode to."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary(), decoded=True)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("benchmark decontamination", leak_stage),
    ("bpe tokens", token_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
