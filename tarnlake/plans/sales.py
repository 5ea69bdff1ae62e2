"""Sales reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import average_of_cents, days_before, from_cents, to_cents
from tarnlake.functions.moments import AsOf


def _revenue(precision: int):
    return from_cents(F.sum(to_cents("price") * F.col("quantity")), precision)


def _avg_price():
    return average_of_cents(F.sum(to_cents("price")), F.count("price"))


def sales_by_category(sales: DataFrame) -> DataFrame:
    """Rows, units and revenue per category, best first."""
    return (
        sales.groupBy("category")
        .agg(
            F.count("*").alias("product_count"),
            F.sum("quantity").alias("total_quantity"),
            _revenue(20).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def sales_of_last_days(sales: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Orders, units, revenue and average price per category and region since ``days`` days ago.

    The distinct count shuffles on (category, region, id) first, so a large region is spread.
    """
    return (
        sales.where(F.col("sale_date") >= days_before(as_of, days))
        .groupBy("category", "region")
        .agg(
            F.count_distinct("id").alias("order_count"),
            F.sum("quantity").alias("total_quantity"),
            _revenue(20).alias("total_revenue"),
            _avg_price().alias("avg_price"),
        )
        .orderBy(F.desc("total_revenue"), "category", "region")
    )


def sales_summary(sales: DataFrame) -> DataFrame:
    """Revenue, units, rows and average price per category, region and day."""
    return sales.groupBy("category", "region", "sale_date").agg(
        _revenue(15).alias("total_revenue"),
        F.sum("quantity").alias("total_quantity"),
        F.count("*").alias("order_count"),
        _avg_price().alias("avg_price"),
    )


def hourly_sales_trend(sales: DataFrame, size: str = "1 hour", time_type: str = "timestamp_ntz") -> DataFrame:
    """Revenue and rows per category and hour; a sale day counts as its midnight.

    Streams pass ``time_type="timestamp"`` for a column that carries the watermark.
    """
    sale_time = "sale_timestamp" if "sale_timestamp" in sales.columns else None
    column = F.col(sale_time) if sale_time else F.col("sale_date").cast(time_type)
    return (
        sales.groupBy("category", F.window(column, size))
        .agg(_revenue(20).alias("hourly_revenue"), F.count("*").alias("hourly_orders"))
        .select("category", F.col("window.start").alias("hour_start"), "hourly_revenue", "hourly_orders")
    )


# Parts into which the purchases of an id and day are split.
SPREAD = 16


def purchases(user_events: DataFrame) -> DataFrame:
    return user_events.where(F.col("event_type") == "purchase")


def purchase_sales(user_events: DataFrame, sales: DataFrame, spread: int = SPREAD) -> DataFrame:
    """Purchases with the sales of the same id and day.

    A filter on the right side makes the left join an inner one on id and day. A hot id is split: its
    purchases are dealt into ``spread`` parts by their time, and its few sales go to all of them. Pass
    sales that are limited to the purchases' ids and days (``tables.sales_data`` with ``only``).
    """
    u = purchases(user_events).withColumn("part", F.pmod(F.xxhash64("event_time"), F.lit(spread))).alias("u")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("part")
    s = sales.select("id", "sale_date", "product_name", "category", "price", copies).alias("s")
    same = (
        (F.col("u.user_id") == F.col("s.id")) & (F.col("u.event_date") == F.col("s.sale_date"))
        & (F.col("u.part") == F.col("s.part"))
    )
    return u.join(s, same).select(
        "u.user_id", "u.event_type", "u.event_time", "s.product_name", "s.category", "s.price")


def write_by_day(sales: DataFrame, path: str) -> None:
    """A copy of the sales in a folder per day."""
    sales.hint("rebalance", "sale_date").write.mode("overwrite").partitionBy("sale_date").parquet(path)


def purchase_sales_of_days(user_events: DataFrame, sales_by_day: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``purchase_sales`` on a copy in folders by day, of which only the purchases' days are read.

    Which days these are is known at run time only: their list, at most one row per folder, is broadcast and prunes
    the folders before any file is opened.
    """
    days = purchases(user_events).select("event_date").distinct()
    read = sales_by_day.join(F.broadcast(days), F.col("sale_date") == F.col("event_date"), "left_semi")
    return purchase_sales(user_events, read, spread)
