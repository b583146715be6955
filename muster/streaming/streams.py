"""Structured Streaming forms of ingest, counting and co-timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_wins(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key once, as first seen; a key is forgotten `delay` after its time."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """(hour, n); an hour is given out once the watermark has passed it, later rows are dropped."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("hour"), "n")


def timed_together(left: DataFrame, right: DataFrame, key: str, at: str, by: str, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Pairs of the same `by` at most `seconds` apart, key_a < key_b; state is kept only as long as a partner may come."""
    a = left.withWatermark(at, delay).select(F.col(key).alias("key_a"), F.col(by).alias("by_a"), F.col(at).alias("at_a"))
    b = right.withWatermark(at, delay).select(F.col(key).alias("key_b"), F.col(by).alias("by_b"), F.col(at).alias("at_b"))
    near = F.expr(f"by_a = by_b AND at_b BETWEEN at_a - INTERVAL {seconds} SECONDS AND at_a + INTERVAL {seconds} SECONDS AND key_a < key_b")
    return a.join(b, near).select("key_a", "key_b")


def sessions(stream: DataFrame, by: str, at: str, gap: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """(by, start, end, n) of runs of events without a gap."""
    s = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
