"""Streaming counterparts of batch statistics (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Count, mean and largest value by event type and window; rows later than ``late`` are dropped. Works on streams and tables."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "top")


def streamed_histogram(points: DataFrame, bounds: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """Pixel counts that grow with a stream of points."""
    from punctaria.operators.image import histogram2d

    return histogram2d(points, bounds, nx, ny)
