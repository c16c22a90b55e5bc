"""Streams of events; each gives what its batch twin gives once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """events (user_id, ts) -> user_id, started, n of each session, which ends after `gap` without an event. State is
    bounded by the watermark: events later than `late` are left out."""
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), "n")


def counters(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """events (name, ts) -> name, start, n: events of each name in each window."""
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("name", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("name", F.col("w.start").alias("start"), "n")


def windowed_metrics(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """events (name, ts, value) -> name, start, n, avg, p50, p95 of each tumbling window, or sliding one with `slide`. The
    quantiles are approximate ones of bounded size; null values count in n alone."""
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("name", F.window("ts", width, slide or width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg"), F.percentile_approx("value", 0.5, 10_000).alias("p50"), F.percentile_approx("value", 0.95, 10_000).alias("p95")
    )
    return found.select("name", F.col("w.start").alias("start"), "n", "avg", "p50", "p95")


def dedupe_jobs(jobs: DataFrame, keys: tuple[str, ...] = ("user_id", "session_id", "kind"), late: str = "1 hour") -> DataFrame:
    """The first job of its keys; the same one is left out while it may still be in flight, for at least `late` after it."""
    return jobs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(list(keys))


def progress(events: DataFrame) -> DataFrame:
    """events (file_id, lease, value) -> greatest progress of each lease, 0 to 100. For update or complete mode."""
    return events.groupBy("file_id", "lease").agg(F.max(F.greatest(F.lit(0), F.least(F.lit(100), F.col("value")))).alias("progress"))


def run_status(events: DataFrame) -> DataFrame:
    """events (run_id, seq, status) -> last status of each run by seq, and its events. For update or complete mode."""
    return events.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("n"))
