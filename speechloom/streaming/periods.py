"""Interval operators over streams: periods by session windows with a watermark, and running pause statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_periods(events: DataFrame, key: str, at: str, seconds: str, late: str = "10 minutes") -> DataFrame:
    """Periods of a stream of intervals (key, at TIMESTAMP, seconds DOUBLE): key, period_start, period_end, n. A period
    comes out once the watermark passes its end; rows later than `late` are left out."""
    length = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast({seconds} as decimal(18, 6)))")
    return (
        events.filter(F.col(seconds) > 0).withWatermark(at, late).groupBy(key, F.session_window(at, length).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "n")
    )


def streaming_pause_counts(events: DataFrame, key: str, at: str, is_pause: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pauses and events of each tumbling window and key."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, window).alias("w")).agg(F.count_if(F.expr(is_pause)).alias("n_pauses"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), "n_pauses", "n")
