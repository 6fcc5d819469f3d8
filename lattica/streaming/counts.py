"""Counts over event time, an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n) per tumbling window; the same plan runs on a batch and on a stream."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(at, window).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")
