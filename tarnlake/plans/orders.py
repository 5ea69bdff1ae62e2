"""Order and product sales jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import average_of_cents, from_cents, to_cents
from tarnlake.operators import as_of_join, latest_per_key


def _order_cents():
    return to_cents("price") * F.col("quantity")


def order_summary(orders: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Number, amount, average and first and last time of the orders per user and window."""
    cents = _order_cents()
    return (
        orders.groupBy("user_id", F.window("order_time", size))
        .agg(
            F.count("*").alias("total_orders"),
            from_cents(F.sum(cents)).alias("total_amount"),
            average_of_cents(F.sum(cents), F.count(cents)).alias("avg_order_value"),
            F.min("order_time").alias("first_order_time"),
            F.max("order_time").alias("last_order_time"),
        )
        .select(
            "user_id",
            "total_orders",
            "total_amount",
            "avg_order_value",
            "first_order_time",
            "last_order_time",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
        )
    )


def product_windows(orders: DataFrame, size: str = "15 minutes") -> DataFrame:
    """Units, revenue and average price per product and window, without product attributes."""
    cents = to_cents("price")
    return (
        orders.groupBy("product_id", F.window("order_time", size))
        .agg(
            F.sum("quantity").alias("total_sales"),
            from_cents(F.sum(_order_cents())).alias("total_revenue"),
            average_of_cents(F.sum(cents), F.count(cents)).alias("avg_price"),
        )
        .select(
            "product_id",
            "total_sales",
            "total_revenue",
            "avg_price",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
        )
    )


def latest_products(products: DataFrame) -> DataFrame:
    """The newest row of every product."""
    return latest_per_key(products, ["product_id"], ["update_time"])


def with_product(windows: DataFrame, products: DataFrame) -> DataFrame:
    """Product windows with name and category; ``products`` has one row per product."""
    return windows.join(
        products.select("product_id", "product_name", "category"), "product_id", "left"
    ).select(
        "product_id", "product_name", "category", "total_sales", "total_revenue", "avg_price",
        "window_start", "window_end",
    )


def product_sales_stats(orders: DataFrame, products: DataFrame, size: str = "15 minutes") -> DataFrame:
    """Sales per product and window with the product's current name and category.

    Orders join the latest row of a product, so an update of a product does not multiply its
    orders. Name and category depend on the product alone: aggregating before the join gives the
    same groups, and a product with a third of all orders reaches the join as one row per window.
    """
    if "update_time" in products.columns:
        products = latest_products(products)
    return with_product(product_windows(orders, size), products)


def orders_with_product_then(orders: DataFrame, updates: DataFrame, slice_: str = "1 hour") -> DataFrame:
    """Orders with the product's name, category and list price as they were at the order's time.

    ``updates`` are versions of products by ``update_time``. An order before the first version has none.
    """
    return as_of_join(
        orders, updates, ["product_id"], "order_time", "update_time", ["product_name", "category", "list_price"], slice_)


def product_sales_then(orders: DataFrame, updates: DataFrame, slice_: str = "1 hour", size: str = "15 minutes") -> DataFrame:
    """Units and revenue per window, product and the category that it had when it was ordered."""
    known = orders_with_product_then(orders, updates, slice_)
    return known.groupBy("product_id", "category", F.window("order_time", size)).agg(
        F.sum("quantity").alias("total_sales"), from_cents(F.sum(_order_cents())).alias("total_revenue"),
    ).select("product_id", "category", "total_sales", "total_revenue", F.col("window.start").alias("window_start"))
