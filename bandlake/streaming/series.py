"""Streaming extension: event streams as series, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.functions import transforms


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event times as timestamps; a stream gets its watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late) if events.isStreaming else timed


def windowed_stats(events: DataFrame, time: str, value: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, mean and deviation of each group and event-time window; rows later than the watermark are dropped."""
    marked = _marked(events, time, late)
    found = marked.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "mean", "std")


def windowed_spectra(events: DataFrame, time: str, value: str, by: list[str], width: str = "8 hours", bucket: str = "1 hour", n_buckets: int = 8, late: str = "1 hour") -> DataFrame:
    """The magnitude spectrum of each window's series of bucket sums (buckets without events are 0)."""
    marked = _marked(events, time, late)
    w = F.window(time, width)
    seconds = F.unix_timestamp(F.window(time, bucket)["start"])
    sums = marked.withColumn("_w", w).withColumn("_b", ((seconds - F.unix_timestamp("_w.start")) / F.expr(f"unix_timestamp(timestamp'1970-01-01 00:00:00' + interval {bucket}) - unix_timestamp(timestamp'1970-01-01 00:00:00')")).cast("int"))
    parts = [F.sum(F.when(F.col("_b") == i, F.col(value)).otherwise(F.lit(0.0))).alias(f"b{i}") for i in range(n_buckets)]
    series = sums.groupBy("_w", *by).agg(*parts)
    return series.select(F.col("_w.start").alias("start"), *by, transforms.rfft_magnitude(F.array(*(F.col(f"b{i}") for i in range(n_buckets)))).alias("spectrum"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = _marked(events, time, late)
    found = marked.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
