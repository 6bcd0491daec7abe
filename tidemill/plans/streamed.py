"""Queries that run as streams over what there is, and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.relational import query
from tidemill.session import Scratch
from tidemill.sources import table
from tidemill.streaming import events as streaming
from tidemill.streaming.sessions import closed_sessions, followed, rocks
from tidemill.streaming.sink import KeyedSink


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in table(spark, sf_dir, "events").dtypes)
    return streaming.read_events(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", schema)  # a pattern, as a stream takes no path of a single file


@query("""
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, s
HAVING epoch_us(max(ts)) // 1000 + 21600001 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)
""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that event time has closed, by state and timers."""
    path = Scratch(spark, "stream").path
    with rocks(spark):
        found = closed_sessions(_stream(spark, sf_dir), "user_id", "value", 21_600_000)
        streaming.to_files(found, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").select(F.col("key").alias("user_id"), "start", "last", "n", F.round("total", 2).alias("total"))


@query("""
SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'
""")
def streamed_purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined by user and time."""
    path, events = Scratch(spark, "stream").path, _stream(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    clicks, bought = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("click", "purchase"))
    pairs = followed(clicks, bought, "user_id", "1 HOUR").select(F.col("first_event_id").alias("click_id"), F.col("then_event_id").alias("purchase_id"))
    streaming.to_files(pairs, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{path}/out")


@query("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL
""")
def streamed_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of a day, kept by a sink that merges batches by key."""
    path = Scratch(spark, "stream").path
    sink = KeyedSink(f"{path}/sink", "user_id long, event_id long, ts timestamp, value double, day string", "day", ["user_id"], ["ts", "event_id"])
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "ts", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    rows.writeStream.foreachBatch(sink.upsert).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark).select("user_id", "day", "event_id", "value")
