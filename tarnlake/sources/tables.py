"""Typed job inputs derived from the benchmark tables.

The jobs read streams and tables of their own schemas; these views map the given Parquet tables to
them. Every view is lazy, so column pruning and filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payload_key():
    return F.get_json_object("props", "$.k").cast("bigint")


def behavior_from(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id",
        F.col("event_id").alias("item_id"),
        _payload_key().alias("category_id"),
        F.col("event_type").alias("behavior"),
        "ts",
    )


def orders_from(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"),
        "user_id",
        _payload_key().alias("product_id"),
        (F.lit(1) + F.col("event_id") % 5).cast("int").alias("quantity"),
        F.col("value").cast("decimal(10,2)").alias("price"),
        F.col("ts").alias("order_time"),
    )


def user_events_from(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id",
        "event_type",
        F.col("ts").alias("event_time"),
        F.col("props").alias("properties"),
        F.to_date("ts").alias("event_date"),
    )


def words_from(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("word"), F.lit(1).cast("bigint").alias("count"), "ts"
    )


def user_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior_from(table(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_from(table(spark, sf_dir, "events"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events_from(table(spark, sf_dir, "events"))


def word_count_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_from(table(spark, sf_dir, "events"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
    )


def orders_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's customer and date: the large input of the order jobs."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("o_orderdate").alias("order_time"),
        )
    )


def _sale_date():
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int"))


def sales_data(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Order lines with product and region. The join strategies are left to the optimizer, which
    broadcasts a side only below its size limit and splits skewed partitions at run time.

    ``only`` (columns id and sale_date) keeps the lines of these ids and days, before any join.
    """
    line = table(spark, sf_dir, "lineitem")
    if only is not None:
        line = line.join(
            only.distinct(), (F.col("l_orderkey") == F.col("id")) & (_sale_date() == F.col("sale_date")), "left_semi")
    place = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    order_place = table(spark, sf_dir, "orders").join(
        place, F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "r_name")
    return (
        line.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(order_place, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _sale_date().alias("sale_date"),
            F.col("r_name").alias("region"),
        )
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series on a 15-second grid, in long form: a counter that restarts every hour, a used
    and a maximum gauge (the maximum of job0 is zero)."""
    events = table(spark, sf_dir, "events")
    slot = F.col("event_id") % 5
    wide = events.select(
        F.concat(F.lit("job"), slot.cast("string")).alias("job_name"),
        slot.alias("slot"),
        F.expr(
            "timestampadd(SECOND, 15 * CAST(event_id DIV 5 AS INT), "
            "TIMESTAMP_NTZ '2024-01-01 00:00:00')"
        ).alias("ts"),
        F.col("value").cast("decimal(10,2)").alias("v"),
    )
    running = F.expr("sum(v) OVER (PARTITION BY slot, date_trunc('hour', ts) ORDER BY ts)")
    counted = wide.withColumn("counter", running.cast("double"))
    return counted.select(
        F.create_map(F.lit("job_name"), F.col("job_name")).alias("labels"),
        "ts",
        F.explode(
            F.create_map(
                F.lit("records_total"), F.col("counter"),
                F.lit("heap_used"), F.col("v").cast("double"),
                F.lit("heap_max"), (F.col("slot") * 100).cast("double"),
            )
        ).alias("metric", "value"),
    ).select("metric", "labels", "ts", "value")


def value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the events as a gauge per event type, at the times of the events: an uneven series with gaps."""
    return table(spark, sf_dir, "events").select(
        F.lit("event_value").alias("metric"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), "ts", "value")


def product_updates_from(events: DataFrame) -> DataFrame:
    """Views as updates of the product that they name."""
    return events.where(F.col("event_type") == "view").select(
        _payload_key().alias("product_id"),
        F.concat(F.lit("product "), F.col("event_id").cast("string")).alias("product_name"),
        F.concat(F.lit("category "), (F.col("user_id") % 7).cast("string")).alias("category"),
        F.col("value").cast("decimal(10,2)").alias("list_price"),
        F.col("ts").alias("update_time"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with payloads of a shape of their own per type; those of errors are cut off."""
    value, user = F.col("value").cast("decimal(10,2)").cast("string"), F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"page": "/p/'), user, F.lit('", "source": "web", "props": '), "props", F.lit("}")))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit('{"total": '), value, F.lit(', "items": [{"id": '), user, F.lit(', "n": 1}], "gift": '),
            F.when(F.col("user_id") % 2 == 0, "true").otherwise("null"), F.lit("}")))
        .when(F.col("event_type") == "signup", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("["), user, F.lit("]"))).otherwise(
            F.concat(F.lit('{"user": '), user, F.lit(', "note": ""}'))))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"code": '), user))
        .otherwise(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", "event_type", text.alias("payload"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("svc"), (F.col("user_id") % 11).cast("string")).alias("service"),
        "ts",
        F.concat("event_type", F.lit(" "), "props").alias("line"),
    )


def services(spark: SparkSession) -> DataFrame:
    """The services whose logs there are."""
    return spark.range(11).select(F.concat(F.lit("svc"), F.col("id").cast("string")).alias("service"))


def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("namespace"),
        F.concat(F.lit("pod"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("user_id") % 7 == 0, "Pending").otherwise("Running").alias("status"),
        F.col("ts").alias("last_ts"),
        F.when(F.col("event_type") == "error", "Failed probe")
        .when(F.col("user_id") % 13 == 0, "Warning: unhealthy").otherwise("Normal").alias("message"),
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of users: one commit per day, an ``error`` event deletes its user."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        "event_id",
        F.col("value").cast("decimal(10,2)").alias("amount"),
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "error", "D").otherwise("U").alias("_op"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1)
        .cast("bigint").alias("_commit_version"),
        F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz").alias("_commit_ts"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")
