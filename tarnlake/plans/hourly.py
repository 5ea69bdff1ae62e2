"""Hourly aggregates of behaviour and revenue in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import to_cents


def hourly_aggregations(behavior: DataFrame, orders: DataFrame, size: str = "1 hour") -> DataFrame:
    """Events per behaviour and hour, and order revenue per hour in whole units.

    The value column is a BIGINT; revenue is truncated toward zero.
    """
    per_behavior = (
        behavior.groupBy("behavior", F.window("ts", size))
        .agg(F.count("*").alias("aggregation_value"))
        .select(
            F.lit("user_behavior").alias("aggregation_type"),
            F.col("behavior").alias("aggregation_key"),
            "aggregation_value",
            F.col("window.start").alias("aggregation_time"),
        )
    )
    revenue = (
        orders.groupBy(F.window("order_time", size))
        .agg(F.sum(to_cents("price") * F.col("quantity")).alias("cents"))
        .select(
            F.lit("order_revenue").alias("aggregation_type"),
            F.lit("total").alias("aggregation_key"),
            F.expr("cents DIV 100").alias("aggregation_value"),
            F.col("window.start").alias("aggregation_time"),
        )
    )
    return per_behavior.unionByName(revenue)
