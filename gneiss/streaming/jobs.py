"""Streaming forms of job events: windows, sessions, deduplication.  Each also takes a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; later rows than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def leases(beats: DataFrame, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, expires, beats): runs of beats no further apart than a lease."""
    s = beats.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("beats"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("expires"), "beats")


def distinct_messages(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each run, type and payload within the watermark."""
    keys = ["user_id", "event_type", "props"]
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All rows of a stream over the files that are there, as a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
