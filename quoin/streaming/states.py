"""Structured Streaming forms of the state and rate-limit operators.

Each takes a streaming frame of events and returns a streaming frame. ``drained`` runs one to
the end of what its source holds and returns the rows as a batch frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.session import shared_folder


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files, be it one file or a folder of parts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")


def requests_per_minute(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of each user and minute. In append mode a window is given out, and its state
    dropped, when the watermark has passed it: ``late`` after the last event seen."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("minute"), "n")


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each user; state is one row a user."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("updated_at"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives until its source is read up, written to the shared folder
    (complete mode: the last batch's) and reread."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/quoin-stream-{uuid.uuid4().hex}"
    # the only state store that keeps timers and several states by key
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote before
        name = "all" if mode == "complete" else f"part={number}"
        batch.write.mode("overwrite").parquet(f"{base}/rows/{name}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    where = f"{base}/rows/all" if mode == "complete" else f"{base}/rows"
    return spark.read.schema(stream.schema).parquet(where).select(*stream.columns)


def query_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(latest_states(events_stream(spark, sf_dir)), "complete")


def query_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(requests_per_minute(events_stream(spark, sf_dir)), "append")


SQL = {
    "l01_latest_state_stream": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS updated_at FROM events GROUP BY user_id",
    "l11_rate_limit_stream": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY user_id, date_trunc('minute', ts)",
}
QUERIES = {"l01_latest_state_stream": query_latest, "l11_rate_limit_stream": query_per_minute}
