"""Event-time windows with watermarks, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``ts`` as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and their value by type and window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of a user's events: a quiet gap ends one."""
    return timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def distinct_events(events: DataFrame) -> DataFrame:
    """Repeated deliveries dropped within the watermark."""
    return timed(events).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
