"""Counts of events by window as a stream, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of Parquet files; event time becomes a timestamp, as watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; a window is final once the watermark has passed it.

    Defined results: rows with a null time are in no window; a null type is a type like any other, null values add nothing; rows of a window that the watermark had
    passed before their batch are late and dropped; repeated rows count each.
    """
    by = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = events.withWatermark("ts", late).groupBy(by, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of an id that come within the watermark.

    Defined results: of a batch's repeats any one stays; a null id is an id like any other; rows later than the watermark are dropped; a repeat that comes when the first is
    older than the watermark counts as new.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def to_files(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what there is and stop; a restart with the same checkpoint goes on exactly once."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
