"""Streaming forms of the trackers: first-seen marks, running counts and windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key's first event within the watermark; state older than the delay is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, key: str, time: str = "ts", size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, key, n) per window of event time, final once the watermark has passed."""
    counts = events.withWatermark(time, delay).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")
