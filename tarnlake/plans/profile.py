"""User profiles and recommendations over the summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import greatest_or_null, moment, since, spend_score
from tarnlake.functions.moments import AsOf
from tarnlake.operators import latest_per_key, top_rows


def user_profile_changes(
    behavior_summary: DataFrame,
    order_summary: DataFrame,
    as_of: AsOf = None,
    look_back: str = "1 hour",
) -> DataFrame:
    """One row per user and behaviour of the last hour, with the user's orders of that hour.

    ``last_activity_time`` is NULL for a user without orders: the source's GREATEST is NULL if any
    argument is.
    """
    behavior = (
        behavior_summary.where(since(behavior_summary, "window_start", as_of, look_back))
        .groupBy("user_id", "behavior_type")
        .agg(
            F.sum("behavior_count").alias("behavior_count"),
            F.max("last_behavior_time").alias("last_behavior_time"),
        )
    )
    orders = (
        order_summary.where(since(order_summary, "window_start", as_of, look_back))
        .groupBy("user_id")
        .agg(
            F.sum("total_orders").alias("total_orders"),
            F.sum("total_amount").cast("decimal(15,2)").alias("total_amount"),
            F.max("last_order_time").alias("last_order_time"),
        )
    )
    time_type = behavior_summary.schema["window_start"].dataType
    return behavior.join(orders, "user_id", "left").select(
        "user_id",
        F.col("behavior_count").alias("total_behaviors"),
        F.coalesce("total_orders", F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce("total_amount", F.lit(0).cast("decimal(15,2)")).alias("total_spent"),
        F.col("behavior_type").alias("favorite_category"),
        greatest_or_null(F.col("last_behavior_time"), F.col("last_order_time"))
        .alias("last_activity_time"),
        moment(as_of, time_type).alias("update_time"),
    )


def user_profile(changes: DataFrame) -> DataFrame:
    """One row per user: the most frequent behaviour wins, then the latest activity, then the
    greatest name. (The keyed table would keep whichever row came last, which is not defined.)"""
    return latest_per_key(
        changes, ["user_id"], ["total_behaviors", "last_activity_time", "favorite_category"]
    )


def _best_products(product_stats: DataFrame, as_of: AsOf, look_back: str, limit: int) -> DataFrame:
    """One row with the array of the best products of the last hour by their best window, in order."""
    best = (
        product_stats.where(since(product_stats, "window_start", as_of, look_back))
        .groupBy("product_id")
        .agg(F.max("total_revenue").alias("best_revenue"))
    )
    best = top_rows(best, F.desc("best_revenue"), ["product_id"], limit)
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("best_revenue")).alias("rank"), "product_id"))
    )
    return best.agg(F.transform(ranked, lambda row: row["product_id"]).alias("products"))


def _scored(
    profiles: DataFrame,
    product_stats: DataFrame,
    as_of: AsOf,
    look_back: str,
    active_within: str,
    limit: int,
) -> DataFrame:
    # Every active user gets the same short list, which is a scalar: no join is needed for it.
    best = _best_products(product_stats, as_of, look_back, limit)
    time_type = profiles.schema["last_activity_time"].dataType
    return profiles.where(since(profiles, "last_activity_time", as_of, active_within)).select(
        "user_id",
        best.scalar().alias("products"),
        spend_score(F.col("total_spent")).alias("recommendation_score"),
        moment(as_of, time_type).alias("recommendation_time"),
    )


def recommendation_candidates(
    profiles: DataFrame,
    product_stats: DataFrame,
    as_of: AsOf = None,
    look_back: str = "1 hour",
    active_within: str = "30 minutes",
    limit: int = 10,
) -> DataFrame:
    """Every recently active user with each of the best products, one row per pair."""
    scored = _scored(profiles, product_stats, as_of, look_back, active_within, limit)
    return scored.withColumn("product_id", F.explode("products")).select(
        "user_id",
        F.array("product_id").alias("recommended_products"),
        "recommendation_score",
        "recommendation_time",
    )


def recommendations(
    profiles: DataFrame,
    product_stats: DataFrame,
    as_of: AsOf = None,
    look_back: str = "1 hour",
    active_within: str = "30 minutes",
    limit: int = 10,
) -> DataFrame:
    """One row per recently active user with all best products in rank order."""
    scored = _scored(profiles, product_stats, as_of, look_back, active_within, limit)
    return scored.where(F.size("products") > 0).select(
        "user_id",
        F.col("products").alias("recommended_products"),
        "recommendation_score",
        "recommendation_time",
    )
