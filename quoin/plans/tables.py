"""Queries over written tables and files: repeated inserts, rows by job, schemas that grow, page files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import search
from quoin.plans.registry import QUERIES, SQL
from quoin.session import shared_folder
from quoin.sources import page_files, tables
from quoin.sources.bridge import duck, frame


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quoin-{uuid.uuid4().hex}"


def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejection is sent twice, the whole stream is run twice, and a batch is replayed."""
    base = folder(spark)
    sent = frame(spark, sf_dir, "feedback").select("correction_id", "id", "job_id", "reason_code", "comment")
    sent.union(sent.withColumn("id", F.concat("id", F.lit("-again")))).write.parquet(f"{base}/sent")
    schema = spark.read.parquet(f"{base}/sent").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/sent")
    for run in ("first", "second"):
        tables.insert_stream(stream, f"{base}/feedback", "correction_id", run, f"{base}/state-{run}")
    tables.insert_new(spark.read.parquet(f"{base}/sent"), f"{base}/feedback", "correction_id", "first", 1 << 40)
    return spark.read.parquet(f"{base}/feedback").select("correction_id", "id", "job_id", "reason_code")


QUERIES["d07_insert_once"] = inserted_once
SQL["d07_insert_once"] = duck("SELECT id AS correction_id, concat('fb-', id) AS id, job_id, reason_code FROM (SELECT correction_id AS id, job_id, reason_code FROM {feedback})")


def reset_and_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections and states of all jobs are inserted, twice; every job is asked to be reset, which
    the failed ones are; those are analysed again and give other rows."""
    base = folder(spark)
    # the views are made once, however often their rows are sent
    rows = tables.staged(frame(spark, sf_dir, "corrections").select("job_id", "id", "seq", "category"))
    states = tables.staged(frame(spark, sf_dir, "jobs").select(F.col("id").alias("job_id"), "status", F.lit(60).alias("progress"), "corrections_count"))
    for _ in range(2):
        tables.insert_by_job(rows, f"{base}/corrections")
        tables.insert_by_job(states, f"{base}/jobs")
    answer = tables.reset_jobs(spark, f"{base}/corrections", rows.schema, f"{base}/jobs", states.schema, states.select("job_id"))
    again = rows.where("seq % 2 = 0").join(answer.where("accepted").select("job_id"), "job_id", "left_semi").select(*rows.columns)
    tables.insert_by_job(again, f"{base}/corrections")
    left = tables.read_by_job(spark, f"{base}/corrections", rows.schema)
    return left.join(tables.read_by_job(spark, f"{base}/jobs", states.schema), "job_id").select("job_id", "id", "category", "status", "progress", "corrections_count")


QUERIES["l05_reset_and_retry"] = reset_and_retried
SQL["l05_reset_and_retry"] = duck("""SELECT k.job_id, k.id, k.category, CASE WHEN status = 'error' THEN 'awaiting_confirmation' ELSE status END AS status, CASE WHEN status = 'error' THEN 0 ELSE 60 END AS progress,
  CASE WHEN status = 'error' THEN 0 ELSE corrections_count END AS corrections_count FROM {corrections} k JOIN {jobs} j ON j.id = k.job_id WHERE status <> 'error' OR seq % 2 = 0""")

#: What columns of older files count as: fixed values.
DEFAULTS = {"preset": "complete", "annotated_count": 0, "doc_type": "autre"}


def evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in files of an old schema, with narrower types and fewer columns, and of a new one."""
    base = folder(spark)
    jobs = frame(spark, sf_dir, "jobs")
    old = jobs.where("user_id % 2 = 0").select("id", "status", F.col("pages_count").cast("int"), F.col("user_id").cast("int"))
    new = jobs.where("user_id % 2 = 1").select("id", "status", F.col("pages_count").cast("long"), F.col("user_id").cast("int"), "preset", "annotated_count", "doc_type", "actual_cost_usd")
    old.write.parquet(base)
    new.write.mode("append").parquet(base)
    return tables.read_evolved(spark, base, tables.evolved_schema(old.schema, new.schema), DEFAULTS)


QUERIES["s12_evolved_files"] = evolved
SQL["s12_evolved_files"] = duck("""SELECT id, status, pages_count::BIGINT AS pages_count, user_id::INT AS user_id, CASE WHEN user_id % 2 = 0 THEN 'complete' ELSE preset END AS preset, CASE WHEN user_id % 2 = 0 THEN 0 ELSE annotated_count END AS annotated_count,
  CASE WHEN user_id % 2 = 0 THEN 'autre' ELSE doc_type END AS doc_type, CASE WHEN user_id % 2 = 1 THEN actual_cost_usd END AS actual_cost_usd FROM {jobs}""")

VOLUME_DOCS, PIECE_BYTES = 100, 64 << 10


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents bound to volumes of a hundred, a line a page, written as page files and read back
    in pieces, several of a file."""
    base = folder(spark)
    lines = frame(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / VOLUME_DOCS).alias("volume"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    page_files.write_pages(lines, base, "volume", "doc_id", "line")
    pages = page_files.read_pages(spark, base, PIECE_BYTES)
    return pages.select(F.regexp_extract("path", "volume=([0-9]+)", 1).cast("long").alias("volume"), "page_num", "text", "word_count")


QUERIES["s01_page_files"] = volumes
SQL["s01_page_files"] = f"""WITH l AS (SELECT doc_id, doc_id // {VOLUME_DOCS} AS volume, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)
  SELECT volume, (row_number() OVER (PARTITION BY volume ORDER BY doc_id, line) - 1)::INT AS page_num, replace(text, chr(12), ' ') AS text, len(list_filter(regexp_split_to_array(replace(text, chr(12), ' '), '[\\s\\x{{A0}}\\x{{202F}}]+'), lambda w: w <> ''))::INT AS word_count FROM l"""

#: Needles of one to thirty characters.
NEEDLES = ["é", "2", "ac", "mot", "lace", "Terme", "steel", "saut de ligne", "double  espace", "coupure SYLLABIQUE détectée", "un saut de ligne parasite dans"]
SEARCHED = ["original_text", "corrected_text", "description", "explanation"]


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all corrections, and what each needle finds in it."""
    path = folder(spark)
    search.write_index(frame(spark, sf_dir, "corrections"), "id", SEARCHED, path)
    return search.find_all(spark, path, NEEDLES)


QUERIES["o06_search_index"] = searched
SQL["o06_search_index"] = duck("SELECT n AS needle, id FROM {corrections}, (SELECT unnest([" + ", ".join(f"'{n}'" for n in NEEDLES) + "]) AS n) WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), lower(n))" for c in SEARCHED))
