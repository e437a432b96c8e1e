"""Streaming deduplication: an extension for the stored task fields time_window and reserve_policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(events: DataFrame, keys: list[str], time: str = "ts", window: str = "60 seconds") -> DataFrame:
    """Drops rows whose keys were seen within the window; state older than the watermark is let go."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, window).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, kind: str, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by kind and tumbling window, late rows within the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"))
