"""Data quality, table metrics and system monitoring."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import (
    alert_level,
    average_of_cents,
    completeness_score,
    day_of,
    interval_seconds,
    moment,
    presence_score,
    since,
)
from tarnlake.functions.moments import AsOf
from tarnlake.functions.scores import ALERT_THRESHOLD


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dq_record_count(
    summaries: Mapping[str, DataFrame], as_of: AsOf = None, look_back: str = "1 hour"
) -> DataFrame:
    """Rows of each summary table in the look-back, scored 100 if there are any."""
    return union_all([
        summary.where(since(summary, "window_start", as_of, look_back))
        .agg(F.count("*").alias("metric_value"))
        .select(
            F.lit(name).alias("table_name"),
            F.lit("record_count").alias("metric_type"),
            "metric_value",
            presence_score(F.col("metric_value")).alias("quality_score"),
            moment(as_of, summary.schema["window_start"].dataType).alias("check_time"),
        )
        for name, summary in summaries.items()
    ])


def dq_completeness(user_events: DataFrame, as_of: AsOf = None, table_name: str = "user_events") -> DataFrame:
    """Rows, NULL users, repeated users and completeness of the day's events.

    The duplicate count is rows minus distinct users, so a NULL user counts as a duplicate.
    """
    return (
        user_events.where(F.col("event_date") == day_of(as_of))
        .agg(
            F.count("*").alias("record_count"),
            F.count(F.when(F.col("user_id").isNull(), 1)).alias("null_count"),
            F.count_distinct("user_id").alias("users"),
        )
        .select(
            F.lit(table_name).alias("table_name"),
            day_of(as_of).alias("metric_date"),
            "record_count",
            "null_count",
            (F.col("record_count") - F.col("users")).alias("duplicate_count"),
            completeness_score(F.col("record_count"), F.col("null_count")).alias("data_quality_score"),
        )
    )


def table_metrics(user_events: DataFrame, as_of: AsOf = None, table_name: str = "user_events") -> DataFrame:
    """The day's record count of a table as a metric row."""
    return (
        user_events.where(F.col("event_date") == day_of(as_of))
        .agg(F.count("*").alias("metric_value"))
        .select(
            F.lit(table_name).alias("table_name"),
            moment(as_of).alias("metric_time"),
            F.lit("record_count").alias("metric_type"),
            "metric_value",
        )
    )


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table; a Parquet count reads only footers."""
    return union_all([
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])


def system_monitoring(behavior: DataFrame, as_of: AsOf = None, look_back: str = "1 minute") -> DataFrame:
    """Records per second over the look-back and its alert level."""
    seconds = interval_seconds(look_back)
    return (
        behavior.where(since(behavior, "ts", as_of, look_back))
        .agg(F.count("*").alias("records"))
        .select(
            F.lit("records_per_second").alias("metric_name"),
            average_of_cents(F.col("records") * 100, F.lit(seconds)).alias("metric_value"),
            F.lit("records/s").alias("metric_unit"),
            F.lit(Decimal(ALERT_THRESHOLD)).cast("decimal(10,2)").alias("alert_threshold"),
            alert_level(F.col("records"), seconds).alias("alert_level"),
            moment(as_of, behavior.schema["ts"].dataType).alias("check_time"),
        )
    )
