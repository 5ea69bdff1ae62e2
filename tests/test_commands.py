"""The commands of the package."""

import os

import pytest

from conftest import rows_of
from tarnlake.__main__ import main
from tarnlake.lake import LakeTable
from tarnlake.schemas import TABLES


def test_word_count(spark, folder):
    os.makedirs(f"{folder}/texts")
    with open(f"{folder}/texts/a.txt", "w") as file:
        file.write("to be or\nnot to be\n")
    main(["word-count", f"{folder}/texts", f"{folder}/counts"])
    assert rows_of(spark.read.parquet(f"{folder}/counts")) == [("be", 2), ("not", 1), ("or", 1), ("to", 2)]


def test_stream_compact_and_expire(spark, folder):
    os.makedirs(f"{folder}/feed")
    path = f"{folder}/table"
    run = ["stream", "word_count", path, f"{folder}/progress", "--folder", f"{folder}/feed", "--once"]
    for i in range(3):
        with open(f"{folder}/feed/{i}.txt", "w") as file:
            file.write('{"word": "a", "count": 1, "ts": "2024-01-01T00:00:01.000Z"}\n')
        main(run)
    table = LakeTable(spark, TABLES["word_count"], path)
    assert rows_of(table.read(), "word", "count") == [("a", 3)]
    main(["compact", "word_count", path])
    main(["expire", "word_count", path, "--days", "0", "--keep", "1"])
    assert sorted(table.versions()) == [2, 3]
    assert rows_of(table.read(), "word", "count") == [("a", 3)]


def feed(path, *lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{len(os.listdir(path))}.txt", "w") as file:
        file.write("\n".join(lines) + "\n")


SEEN = '{"user_id": 1, "item_id": 2, "category_id": 3, "behavior": "view", "ts": "2024-01-01T00:10:00.000Z"}'
BOUGHT = ('{"order_id": 1, "user_id": 1, "product_id": 7, "quantity": 2, "price": 600.00, '
          '"order_time": "2024-01-01T00:11:00.000Z"}')
PRODUCT = ('{"product_id": 7, "product_name": "p", "category": "c", "price": 1.00, '
           '"update_time": "2024-01-01T00:00:00.000Z"}')


def test_chains_over_a_warehouse(spark, folder):
    feed(f"{folder}/in/user-behavior", SEEN, "broken")
    feed(f"{folder}/in/orders", BOUGHT)
    feed(f"{folder}/in/products", PRODUCT)

    def stream(job, source, *more):
        main(["stream", job, f"{folder}/w/{job}", f"{folder}/p/{job}", "--folder", f"{folder}/in/{source}", "--once", *more])

    stream("user_behavior_summary", "user-behavior", "--dead-letters", f"{folder}/dead", "--max-per-trigger", "1")
    stream("order_summary", "orders")
    stream("product_sales_stats", "orders", "--products", f"{folder}/in/products")
    stream("hourly_aggregations", "")
    assert [r.reason for r in spark.read.parquet(f"{folder}/dead/user-behavior").collect()] == ["malformed"]
    for job in ("user_profile", "real_time_recommendations", "user_behavior_wide", "dq_record_count"):
        main(["chain", job, f"{folder}/w", f"{folder}/p/{job}", "--as-of", "2024-01-01 00:20:00", "--once"])

    def read(name, *columns):
        return rows_of(LakeTable(spark, TABLES[name], f"{folder}/w/{name}").read(), *columns)

    assert read("user_profile", "user_id", "total_orders") == [(1, 1)]
    assert read("real_time_recommendations", "user_id", "recommended_products") == [(1, [7])]
    assert read("user_behavior_wide", "user_id", "order_count") == [(1, 1)]
    assert read("dq_record_count", "table_name", "metric_value") == [("order_summary", 1), ("user_behavior_summary", 1)]
    assert len(read("hourly_aggregations", "aggregation_type")) == 2


def test_jobs_that_write_files(spark, folder):
    for i in (1, 2, 3):
        feed(f"{folder}/in", f'{{"user_id": {i}, "event_type": "a", "event_time": "2024-01-0{i}T00:00:01.000Z"}}')
        run = [f"{folder}/out", f"{folder}/p", "--folder", f"{folder}/in", "--once"]
        main(["files", "behavior_windows", *run])
    assert spark.read.parquet(f"{folder}/out").count() == 2
    main(["files", "events_by_day", f"{folder}/days", f"{folder}/p2", *run[2:]])
    assert spark.read.parquet(f"{folder}/days").count() == 3


def test_retention(spark, folder):
    config = LakeTable(spark, TABLES["data_cleanup_config"], f"{folder}/data_cleanup_config").create()
    config.commit(spark.sql("SELECT 'word_count' AS table_name, 7 AS retention_days, true AS cleanup_enabled, "
                            "CAST(NULL AS TIMESTAMP) AS last_cleanup_time"))
    table = LakeTable(spark, TABLES["word_count"], f"{folder}/word_count").create()
    table.commit(spark.sql("SELECT 'a' AS word, id AS count, timestampadd(DAY, CAST(id AS INT), TIMESTAMP '2024-01-01') AS window_start, "
                           "TIMESTAMP '2024-01-01' AS window_end FROM range(20)"))
    main(["retention", folder, "--as-of", "2024-01-20 00:00:00"])
    assert table.read().count() == 8
    main(["compact", "word_count", table.path, "--if-needed"])


def test_product_stats_need_products(folder):
    with pytest.raises(SystemExit):
        main(["stream", "product_sales_stats", folder, folder, "--folder", folder])


def test_a_stream_needs_a_source(folder):
    with pytest.raises(SystemExit):
        main(["stream", "word_count", folder, folder])
