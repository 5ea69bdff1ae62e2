"""Scans over service logs and cluster events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import since
from tarnlake.functions.moments import AsOf
from tarnlake.operators import top_rows

# The line patterns of the scans.
ERROR_LINES = "(?i)error|exception|failed"
ERROR_EVENTS = "(?i)error|failed|backoff"
WARNING_EVENTS = "(?i)warning"
PROBLEM_STATUSES = ("Pending", "Error", "CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull")


def error_scan(
    lines: DataFrame, services: DataFrame, as_of: AsOf = None, look_back: str = "1 hour"
) -> DataFrame:
    """Matching lines per service in the look-back; a service without any is listed with 0 and OK.

    ``services`` has one row per service. Lines are counted before the join.
    """
    counts = (
        lines.where(since(lines, "ts", as_of, look_back) & F.col("line").rlike(ERROR_LINES))
        .groupBy("service")
        .agg(F.count("*").alias("n"))
    )
    errors = F.coalesce("n", F.lit(0).cast("bigint"))
    return services.select("service").join(counts, "service", "left").select(
        "service",
        errors.alias("error_count"),
        F.when(errors > 0, "WARN").otherwise("OK").alias("status"),
    )


def latest_events(events: DataFrame, limit: int, pattern: str | None = None) -> DataFrame:
    """The last events by time, newest first; with a pattern, the last ones whose text matches."""
    if pattern is not None:
        text = F.concat_ws(" ", "namespace", "name", "status", "message")
        events = events.where(text.rlike(pattern))
    return top_rows(events, F.desc("last_ts"), ["name"], limit)


def status_rollup(items: DataFrame) -> DataFrame:
    """Running and total items per namespace."""
    return items.groupBy("namespace").agg(
        F.count(F.when(F.col("status") == "Running", 1)).alias("running"),
        F.count("*").alias("total"),
    )


def problem_items(items: DataFrame) -> DataFrame:
    """Items in a status that needs attention."""
    return items.where(F.col("status").isin(*PROBLEM_STATUSES))
