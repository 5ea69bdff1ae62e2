"""User behaviour and user event jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.moments import AsOf, days_before
from tarnlake.operators import bitmaps, counted_by, distinct_per_group


def user_behavior_summary(behavior: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Count, first and last time per user, behaviour and tumbling window."""
    return (
        behavior.groupBy(
            "user_id",
            F.col("behavior").alias("behavior_type"),
            F.window("ts", size),
        )
        .agg(
            F.count("*").alias("behavior_count"),
            F.min("ts").alias("first_behavior_time"),
            F.max("ts").alias("last_behavior_time"),
        )
        .select(
            "user_id",
            "behavior_type",
            "behavior_count",
            "first_behavior_time",
            "last_behavior_time",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
        )
    )


def user_behavior_wide(behavior_summary: DataFrame, order_summary: DataFrame) -> DataFrame:
    """Behaviour windows with the orders of the same user and window start.

    The two summaries have windows of different length, so only starts that are common to both can
    match. Both sides hold one row per key, so no key can fan out.
    """
    orders = order_summary.select(
        "user_id", "window_start", "total_orders", "total_amount", "last_order_time"
    )
    return behavior_summary.join(orders, ["user_id", "window_start"], "left").select(
        "user_id",
        "behavior_type",
        "behavior_count",
        F.coalesce("total_orders", F.lit(0).cast("bigint")).alias("order_count"),
        F.coalesce("total_amount", F.lit(0).cast("decimal(15,2)")).alias("total_spent"),
        F.col("last_behavior_time").alias("behavior_time"),
        F.col("last_order_time").alias("order_time"),
        "window_start",
    )


def events_of_day(user_events: DataFrame, day: str) -> DataFrame:
    """The events of one partition day in time order."""
    return (
        user_events.where(F.col("event_date") == F.lit(day).cast("date"))
        .select("user_id", "event_type", "event_time", "properties")
        .orderBy("event_time", "user_id", "event_type", "properties")
    )


def user_events_hourly(user_events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Distinct users and events per type and hour."""
    return distinct_per_group(
        user_events,
        {"event_type": F.col("event_type"), "window": F.window("event_time", size)},
        "user_id", "user_count", "event_count",
    ).select("event_type", F.col("window.start").alias("event_hour"), "user_count", "event_count")


def user_event_counts(user_events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Events per type, hour and user: kept as a keyed table it gives exact distinct users at any
    time, also for hours that are still open."""
    return (
        user_events.groupBy("event_type", "user_id", F.window("event_time", size))
        .agg(F.count("*").alias("event_count"))
        .select("event_type", "user_id", F.col("window.start").alias("event_hour"), "event_count")
    )


def hourly_from_counts(counts: DataFrame) -> DataFrame:
    """Distinct users and events per type and hour from the counts per user."""
    return counts.groupBy("event_type", "event_hour").agg(
        F.count("user_id").alias("user_count"), F.sum("event_count").alias("event_count")
    )


def user_bitmaps(user_events: DataFrame) -> DataFrame:
    """The users of every type and hour as bitmaps: small rows from which any longer time is counted."""
    return bitmaps.id_bitmaps(
        user_events, {"event_type": F.col("event_type"), "event_hour": F.date_trunc("hour", F.col("event_time").cast("timestamp"))},
        "user_id")


def distinct_users(hourly_bitmaps: DataFrame, unit: str, by_type: bool = True) -> DataFrame:
    """Distinct users and events per ``unit`` (hour, day, week, month …) from the hours' bitmaps."""
    groups = {"event_type": F.col("event_type")} if by_type else {}
    groups["period_start"] = F.date_trunc(unit, "event_hour")
    found = bitmaps.distinct_counts(bitmaps.merged(hourly_bitmaps, groups), list(groups), "user_count", "event_count")
    return found.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


def behavior_windows(user_events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Distinct users and events per type and five-minute window."""
    return distinct_per_group(
        user_events,
        {"event_type": F.col("event_type"), "window": F.window("event_time", size)},
        "user_id", "unique_users", "total_events",
    ).select(
        "event_type",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "unique_users",
        "total_events",
    )


def events_per_type(user_events: DataFrame) -> DataFrame:
    return counted_by(user_events, ["event_type"], "event_count")


def events_per_label(user_events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events per label; types without a label count under none, labels without events with zero.

    Events are counted per type before they meet the labels.
    """
    counts = events_per_type(user_events)
    return counts.join(labels, "event_type", "full").groupBy("label").agg(
        F.coalesce(F.sum("event_count"), F.lit(0).cast("bigint")).alias("event_count"))


def events_before(user_events: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """The rows a retention of ``days`` days would delete."""
    return user_events.where(F.col("event_date") < days_before(as_of, days))


def payload_field(user_events: DataFrame, field: str) -> DataFrame:
    """One field of the JSON payload next to the event."""
    return user_events.select(
        "user_id", "event_type", "event_time",
        F.get_json_object("properties", f"$.{field}").alias(field),
    )
