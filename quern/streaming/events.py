"""Structured Streaming over event files: windows with late data, sessions, and the latest state of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, total) by tumbling, or with ``slide`` sliding, windows; later events than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events with no gap as long as ``gap``."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    out = kept.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def once_per_event(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there and end; the result as a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
