"""Tables of Parquet files that writes can be repeated on: idempotent inserts, rows replaced by job,
files of an old and a new schema together.

A table is a folder of partitions. What a write replaces is a whole partition, which Spark's
committer puts in place of the old one (dynamic partition overwrite), so a write that is run again
leaves the table as the first run did. One writer at a time is assumed, as by any such table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoin.session import shared_folder

#: Partitions that rows are dealt to by the hash of their job.
BUCKETS = 16


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` written beside the table and read again, before what they were read from is replaced."""
    path = f"{shared_folder(rows.sparkSession)}/quoin-staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# ── inserts that can be repeated ───────────────────────────────────────────


def rows_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a table, none if nothing has been written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_new(rows: DataFrame, path: str, key: str, run: str, batch: int) -> None:
    """Append those of ``rows`` whose ``key`` the table lacks; of several in ``rows`` the least row.

    They become the partition (run, batch). When that batch is run again it replaces what it wrote,
    and is compared with all other partitions only, so a replay changes nothing; nor does another
    run over the same rows."""
    spark = rows.sparkSession
    schema = StructType([*rows.schema.fields]).add("run", "string").add("batch", "long")
    there = rows_of(spark, path, schema).where(~((F.col("run") == run) & (F.col("batch") == batch))).select(key)
    one = rows.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("_row"))
    new = one.select(key, "_row.*").select(*rows.columns).join(there, key, "left_anti")
    placed = staged(new.withColumns({"run": F.lit(run), "batch": F.lit(batch).cast("long")}))
    placed.write.partitionBy("run", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def insert_stream(requests: DataFrame, path: str, key: str, run: str, checkpoint: str) -> None:
    """Insert a stream's rows once each, until its source is read up. Batches are told by the
    stream's own numbers, which a restart from its checkpoint keeps. The table itself says which
    keys are there, so no watermark is needed and rows of any age are judged alike."""
    query = requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: insert_new(batch, path, key, run, number)).start()
    query.awaitTermination()


# ── rows by job ────────────────────────────────────────────────────────────


def bucket(job: Column | str = "job_id") -> Column:
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def _replace(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.withColumn("bucket", bucket()).repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _of_jobs(spark: SparkSession, path: str, schema: StructType, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the buckets that ``jobs`` (job_id) are in, and the jobs' own places in them.
    Other buckets are not read: there are ``BUCKETS``, so their numbers are a bounded list."""
    numbers = [r[0] for r in jobs.select(bucket().alias("b")).distinct().collect()]
    stored = StructType([*schema.fields]).add("bucket", "integer")
    return rows_of(spark, path, stored).where(F.col("bucket").isin(numbers) if numbers else F.lit(False)).drop("bucket"), jobs.select("job_id").distinct()


def insert_by_job(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of whatever the table has of their jobs; other jobs stay. Running it
    again changes nothing. Only the buckets of those jobs are read and written."""
    spark = rows.sparkSession
    rows = staged(rows)
    there, jobs = _of_jobs(spark, path, rows.schema, rows)
    _replace(spark, path, staged(there.join(jobs, "job_id", "left_anti").select(*rows.columns).union(rows)))


def delete_by_job(spark: SparkSession, path: str, schema: StructType, jobs: DataFrame) -> None:
    """Take all rows of ``jobs`` (job_id) out. A row without anything but its job is left for each
    of them, so that a bucket is never empty and is replaced; ``read_by_job`` leaves it out."""
    there, gone = _of_jobs(spark, path, schema, jobs)
    marks = gone.select(*(F.col("job_id") if f.name == "job_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
    _replace(spark, path, staged(there.join(gone, "job_id", "left_anti").select(*schema.names).union(marks)))


def read_by_job(spark: SparkSession, path: str, schema: StructType, jobs: list[str] | None = None) -> DataFrame:
    """The table's rows, of ``jobs`` only if named: then only their buckets are read."""
    rows = rows_of(spark, path, StructType([*schema.fields]).add("bucket", "integer"))
    if jobs is not None:
        at = [r[0] for r in spark.createDataFrame([(j,) for j in jobs], "job_id string").select(bucket()).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(at) & F.col("job_id").isin(jobs))
    others = [n for n in schema.names if n != "job_id"]
    return rows.where(" OR ".join(f"`{n}` IS NOT NULL" for n in others)).select(*schema.names)


def reset_jobs(spark: SparkSession, corrections: str, rows_schema: StructType, statuses: str, status_schema: StructType, asked: DataFrame) -> DataFrame:
    """Reset those of the jobs ``asked`` for (job_id) whose status is error: their corrections go,
    they await confirmation again, with no progress and no count. Returns (job_id, accepted): a
    job in any other state is refused and left as it is."""
    now, _ = _of_jobs(spark, statuses, status_schema, asked)
    state = now.join(asked.distinct(), "job_id", "right").select("job_id", (F.coalesce("status", F.lit("")) == "error").alias("accepted"))
    answer = staged(state)
    jobs = answer.where("accepted").select("job_id")
    if jobs.isEmpty():
        return answer
    # rows first: a reset that breaks off between the two is accepted again and repeated
    delete_by_job(spark, corrections, rows_schema, jobs)
    fresh = {"status": F.lit("awaiting_confirmation"), "progress": F.lit(0), "corrections_count": F.lit(0)}
    reset = now.join(jobs, "job_id", "left_semi").select(*status_schema.names).withColumns({k: v.cast(status_schema[k].dataType) for k, v in fresh.items() if k in status_schema.names})
    insert_by_job(reset, statuses)
    return answer


# ── schemas that grow ──────────────────────────────────────────────────────

#: Types that a column may be widened to; files of the narrower one are read as the wider.
WIDER = {("int", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp_ntz")}


def evolved_schema(old: StructType, new: StructType) -> StructType:
    """The columns of both: of a column in both the wider type. Types that do not widen are refused."""
    out = StructType(list(new.fields))
    for field in old.fields:
        if field.name not in new.names:
            out = out.add(field)
            continue
        a, b = field.dataType.simpleString(), new[field.name].dataType.simpleString()
        if a != b and (a, b) not in WIDER:
            raise ValueError(f"column {field.name} can't go from {a} to {b}")
    return out


def read_evolved(spark: SparkSession, path: str, schema: StructType, defaults: dict) -> DataFrame:
    """A folder of files of an old and of newer schemas under one: columns that a file lacks have
    their default, or null without one, as have nulls that newer files hold. Only the columns that
    are asked for are read."""
    return spark.read.schema(schema).parquet(path).na.fill(defaults)
