"""Plans: what reaches the scan, what is broadcast, and what one hot key does."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tarnlake import session
from tarnlake.functions import since
from tarnlake.lake import LakeTable
from tarnlake.lake.catalog import explain
from tarnlake.operators import latest_per_key
from tarnlake.plans import behavior, forest, orders, profile, sales, words
from tarnlake.registry import QUERIES
from tarnlake.schemas import TABLES
from tarnlake.session import scratch_dir, session_conf, stored
from tarnlake.sources import tables
from tarnlake.streaming.runner import RunSettings, upsert_stream

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return explain(QUERIES[name](spark, SF))


def test_columns_are_pruned(spark):
    schemas = re.findall(r"ReadSchema: (\S+)", plan_of(spark, "user_behavior_summary"))
    assert schemas == ["struct<ts:timestamp_ntz,user_id:bigint,event_type:string>"]


@pytest.mark.parametrize("name", ["user_profile", "recommendations", "dq_record_count", "system_monitoring"])
def test_look_backs_reach_the_scan(spark, name):
    pushed = re.findall(r"PushedFilters: (\[.*?\])$", plan_of(spark, name), re.M)
    events = [p for p in pushed if "ts" in p]
    assert events and all("GreaterThanOrEqual(ts" in p for p in events)


def test_no_query_has_a_cross_join(spark):
    for name in sorted(QUERIES):
        if not name.startswith(("stream_", "chain_", "lake_table", "lake_part", "lake_buck", "backup", "staged", "quality_forest")):
            plan = plan_of(spark, name)
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_left_join_with_a_filter_on_the_right_is_inner(spark):
    plan = plan_of(spark, "purchase_sales")
    assert "LeftOuter" not in plan and "Inner" in plan


def test_top_rows_are_taken_per_task(spark):
    for name in ("top_words", "latest_cluster_events"):
        assert "TakeOrderedAndProject" in plan_of(spark, name)


def test_a_large_dimension_is_not_broadcast(spark):
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "1KB"}):
        plan = plan_of(spark, "product_sales_stats_bulk")
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_partition_days_are_pruned_in_merged_reads(spark, folder):
    table = LakeTable(spark, TABLES["user_behavior_summary"], f"{folder}/t").create()
    summary = behavior.user_behavior_summary(tables.user_behavior(spark, SF))
    table.commit(summary)
    recent = table.read().where(since(table.read(), "window_start", "2024-01-30 23:57:30", "1 day"))
    scan = [line for line in explain(recent).splitlines() if "PartitionFilters" in line]
    assert scan and all("window_date" in line for line in scan)


def hot(spark, rows=400_000):
    """A third of the rows belongs to one user and product."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    return spark.range(0, rows, 1, 8).select(
        "id", key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("note"))


def test_latest_per_key_shuffles_one_row_per_key_and_task(spark):
    df = hot(spark)
    latest = latest_per_key(df, ["key"], ["id"])
    plan = explain(latest)
    before_shuffle = plan[plan.index("Exchange"):] if "Exchange" in plan else ""
    assert "partial_max" in plan and "Window" not in plan and before_shuffle
    expected = {r.key: r.id for r in df.groupBy("key").agg(F.max("id").alias("id")).collect()}
    assert {r.key: r.id for r in latest.collect()} == expected


def test_hot_products_meet_the_dimension_after_the_aggregate(spark):
    order_rows = hot(spark).select(
        F.col("id").alias("order_id"), F.col("key").alias("product_id"), F.lit(1).alias("quantity"),
        F.lit("1.50").cast("decimal(10,2)").alias("price"),
        F.timestamp_micros(F.col("id") * 1000).alias("order_time"))
    products = spark.range(5000).selectExpr("id AS product_id", "concat('p', id) AS product_name", "'c' AS category")
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        stats = orders.product_sales_stats(order_rows, products)
        plan = explain(stats)
    assert plan.index("SortMergeJoin") < plan.index("HashAggregate")
    found = stats.where("product_id = 7").first()
    assert (found.product_name, found.total_sales) == ("p7", hot(spark).where("key = 7").count())


def test_a_hot_join_key_is_split(spark):
    events = hot(spark, 300_000).select(
        F.col("key").alias("user_id"), F.lit("purchase").alias("event_type"), F.col("note"),
        F.timestamp_micros("id").cast("timestamp_ntz").alias("event_time"), F.lit("2024-01-01").cast("date").alias("event_date"))
    sale_rows = spark.range(0, 5000, 1, 4).select(
        "id", F.lit("p").alias("product_name"), F.lit("c").alias("category"),
        F.lit("1.00").cast("decimal(10,2)").alias("price"), F.lit("2024-01-01").cast("date").alias("sale_date"))
    plain = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    with session_conf(spark, plain):
        joined = sales.purchase_sales(events, sale_rows).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
    # A third of the rows has one id: unsplit, one task would have over 100,000 rows.
    assert sum(sizes) == 300_000 and max(sizes) < 60_000


def test_sales_are_limited_before_the_joins(spark):
    assert "LeftSemi" in plan_of(spark, "purchase_sales")


def test_bucketed_copies_are_counted_in_many_tasks(spark):
    plan = plan_of(spark, "lake_bucketed_events")
    assert "Bucketed: true" not in plan and "Exchange" in plan


def test_a_hash_distributed_copy_is_joined_and_counted_in_place(spark):
    plan = plan_of(spark, "lake_bucketed_join")
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "HashAggregate" in plan


def test_a_given_list_of_services_spares_a_scan(spark):
    assert plan_of(spark, "log_error_scan").count("Scan parquet") <= 2


def test_hot_words_are_combined_before_the_shuffle(spark):
    texts = spark.range(1000).selectExpr("repeat('the quick the ', 50) AS text")
    plan = explain(words.text_word_count(texts))
    assert "partial_count" in plan
    assert {r.word: r["count"] for r in words.text_word_count(texts).collect()} == {"the": 100_000, "quick": 50_000}


def test_recommendations_read_the_short_list_once(spark):
    found = QUERIES["recommendations_day"](spark, SF)
    found.collect()
    assert "ReusedSubquery" in found._jdf.queryExecution().executedPlan().toString()


def test_distinct_users_of_one_large_group_are_spread(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "id % 50000 AS user_id", "'click' AS event_type", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS event_time")
    found = behavior.user_events_hourly(rows)
    assert [(r.user_count, r.event_count) for r in found.collect()] == [(50_000, 200_000)]
    exchanges = re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", explain(found))
    assert any("user_id" in e for e in exchanges)


def test_forest_split_does_not_depend_on_partitions(spark):
    df = spark.range(10_000)
    train, test = forest.split_rows(df, "id")
    again, _ = forest.split_rows(df.repartition(13), "id")
    assert sorted(r.id for r in train.collect()) == sorted(r.id for r in again.collect())
    assert 1800 < test.count() < 2200 and train.count() + test.count() == 10_000


def test_profile_functions_take_zoned_and_plain_times(spark):
    plain = behavior.user_behavior_summary(tables.user_behavior(spark, SF))
    zoned = plain.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "last_behavior_time")})
    order_rows = orders.order_summary(tables.orders(spark, SF))
    zoned_orders = order_rows.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "last_order_time")})
    a = profile.user_profile_changes(plain, order_rows, "2024-01-30 23:57:30", "5 days").count()
    b = profile.user_profile_changes(zoned, zoned_orders, "2024-01-30 23:57:30", "5 days").count()
    assert a == b > 0


def test_forest_learns_a_separable_target(spark):
    df = spark.range(2000).selectExpr("id", "cast(id % 10 AS double) AS a", "cast(id % 7 AS double) AS b",
                                      "cast(id % 10 >= 5 AS int) AS target")
    found = forest.train_forest(df, "target", "id", trees=5).first()
    assert found.train_rows + found.test_rows == 2000 and found.accuracy == 1.0 and found.filled_rows == 0


def test_forest_keeps_rows_with_missing_features(spark):
    df = spark.range(200).selectExpr("id", "if(id % 2 = 0, NULL, cast(id AS double)) AS a", "cast(id % 2 AS int) AS target")
    found = forest.train_forest(df, "target", "id", trees=5).first()
    assert found.train_rows + found.test_rows == 200 and found.filled_rows == 100


def test_scratch_folder_is_the_one_of_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(f"{root}/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    kept = stored(spark.range(5), "kept")
    assert kept.count() == 5 and "Range" not in explain(kept)


def test_scratch_folders_can_be_dropped(spark, folder):
    kept = stored(spark.range(5), "dropped")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    others = session._given.pop(spark.sparkContext.applicationId)
    session._given[spark.sparkContext.applicationId] = [path]
    assert os.path.isdir(path) and session.drop_scratch(spark) == 1 and not os.path.exists(path)
    session._given[spark.sparkContext.applicationId] = others


def test_overflow_of_a_sum_is_an_error(spark):
    assert session.BASE_CONF["spark.sql.ansi.enabled"] == "true"


def test_update_mode_needs_a_key(spark, folder):
    table = LakeTable(spark, TABLES["user_events_indexed"], f"{folder}/t").create()
    with pytest.raises(ValueError, match="no key"):
        upsert_stream(spark.range(1), table, RunSettings(f"{folder}/p"))
