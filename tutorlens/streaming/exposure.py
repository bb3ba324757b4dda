"""Streaming form of the exposure audit: engaged contents a user has met by window, late events dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exposure_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, event, n, engaged) per tumbling window; works on a stream (ts is the event time) and on a table."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n"), F.count_if(F.expr("event <> 'disliked'")).alias("engaged")).select(F.col("w.start").alias("start"), "event", "n", "engaged")
