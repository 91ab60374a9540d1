"""Streaming queries: the events table as a file stream, drained and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.event_log import ORACLE as BATCH
from quern.runtime import table
from quern.streaming import state as ST


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, since the table may be one file or a folder of files, and a stream can't have a single file as its base.
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ST.drain(ST.latest(_stream(spark, sf), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"]), "update", "user_id")


def stream_staleness(spark: SparkSession, sf: str) -> DataFrame:
    last = ST.drain(ST.latest(_stream(spark, sf), "user_id", ["ts", "event_id"], ["ts"]), "update", "user_id")
    made = ST.staleness(last, "ts", F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")), 43_200, 86_400)
    return made.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_buffer(spark: SparkSession, sf: str) -> DataFrame:
    versions = ST.drain(ST.sliding_buffer(_stream(spark, sf), "user_id", "ts", "event_id", 5 * 86_400, 10), "update")
    newest = Window.partitionBy("user_id").orderBy(F.desc("version"))
    last = versions.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1")
    return last.select("user_id", F.explode("ids").alias("event_id"))


def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    return ST.drain(ST.changes(_stream(spark, sf), "user_id", "ts", "event_id", "event_type"), "append")


def stream_expired(spark: SparkSession, sf: str) -> DataFrame:
    """The users who were silent for two days of event time, and then forgotten."""
    gone = ST.drain(ST.expired(_stream(spark, sf), "user_id", "ts", 2 * 86_400, "1 hour"), "append")
    return gone.select("user_id", F.col("last").cast("timestamp_ntz").alias("last"), "events")


QUERIES = {f.__name__: f for f in (stream_expired, stream_latest, stream_staleness, stream_buffer, stream_changes)}
ORACLE = {
    "stream_expired": "WITH u AS (SELECT user_id, date_trunc('millisecond', max(ts)) AS last, count(*) AS events FROM events GROUP BY 1) SELECT * FROM u WHERE last + INTERVAL 2 DAY < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)",
    "stream_latest": BATCH["latest_per_key"],
    "stream_buffer": BATCH["sliding_buffer"],
    "stream_changes": BATCH["changed_only"],
    "stream_staleness": "WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) SELECT CASE WHEN TIMESTAMP '2024-01-30 12:00:00' - ts < INTERVAL 12 HOUR THEN 'active' WHEN TIMESTAMP '2024-01-30 12:00:00' - ts < INTERVAL 24 HOUR THEN 'stale' ELSE 'dead' END AS status, count(*) AS n FROM l GROUP BY 1",
}
