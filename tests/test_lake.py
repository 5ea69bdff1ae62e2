"""Lake tables: commits, merged reads, time travel, maintenance."""

import glob
import os
import random
import shutil
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tarnlake.lake import LakeTable, changelog, folders, maintenance
from tarnlake.lake.catalog import Catalog, explain
from tarnlake.streaming.runner import RunSettings, started
from tarnlake.schemas import TABLES, TableSpec
from tarnlake.session import session_conf
from tarnlake.schemas import _schema as schema
from pyspark.sql import types as T

PRICES = TableSpec(
    "prices", schema(id=T.LongType(), price=T.LongType(), day=T.DateType()), ("id", "day"),
    partition_by=("day",), order_by=("price",), bucket_by="id",
)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def ms(day: int) -> int:
    return int((START + timedelta(days=day)).timestamp() * 1000)


def price_rows(spark, *rows):
    return spark.createDataFrame(rows, "id bigint, price bigint, day string")


@pytest.fixture()
def prices(spark, folder):
    """Three versions on three days: insert, update and add, delete."""
    table = LakeTable(spark, PRICES, f"{folder}/prices").create()
    table.commit(price_rows(spark, (1, 10, "2024-01-01"), (2, 20, "2024-01-01")), committed_ms=ms(0))
    table.commit(price_rows(spark, (1, 11, "2024-01-01"), (3, 30, "2024-01-02")), committed_ms=ms(1))
    table.delete_where(F.col("id") == 2, committed_ms=ms(2))
    return table


def state(df):
    return rows_of(df, "id", "price")


def test_empty_table(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/none").create()
    assert table.read().count() == 0 and table.latest_version() == 0


def test_merge_on_read(prices):
    assert state(prices.read()) == [(1, 11), (3, 30)]
    assert prices.latest_version() == 3


def test_time_travel(prices):
    assert state(prices.read(version=0)) == []
    assert state(prices.read(version=1)) == [(1, 10), (2, 20)]
    assert state(prices.read(version=2)) == [(1, 11), (2, 20), (3, 30)]
    assert state(prices.read(as_of="2024-01-01 23:59:59")) == [(1, 10), (2, 20)]
    assert state(prices.read(as_of="2024-01-02 00:00:00")) == [(1, 11), (2, 20), (3, 30)]
    assert state(prices.read(as_of="2023-12-31 00:00:00")) == []


def test_incremental_read(prices):
    assert rows_of(prices.changes(1, 3), "id", "price", "_op", "_commit_version") == [
        (1, 11, "U", 2), (2, 20, "D", 3), (3, 30, "U", 2)]
    assert prices.changes(3).count() == 0


def test_snapshots(prices):
    assert rows_of(prices.snapshots(), "_commit_version", "upserts", "deletes") == [
        (1, 2, 0), (2, 2, 0), (3, 0, 1)]


def test_order_within_a_commit(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    table.commit(price_rows(spark, (1, 5, "2024-01-01"), (1, 9, "2024-01-01"), (1, 7, "2024-01-01")))
    assert state(table.read()) == [(1, 9)]


def test_a_batch_is_committed_once(spark, prices):
    """A batch that comes again keeps its number; what was committed after it stays the newer."""
    first = prices.commit(price_rows(spark, (7, 70, "2024-01-03"), (3, 31, "2024-01-02")), batch="q-0")
    assert prices.delete_where(F.col("id") == 3) == first + 1
    assert prices.commit(price_rows(spark, (7, 70, "2024-01-03"), (3, 31, "2024-01-02")), batch="q-0") == first
    assert prices.commit(price_rows(spark, (8, 80, "2024-01-03")), batch="q-1") == first + 2
    assert state(prices.read()) == [(1, 11), (7, 70), (8, 80)]
    assert prices.changes(first - 1, first).count() == 2


@pytest.mark.parametrize("step", ["log", "before the merge", "in the merge"])
def test_an_unfinished_batch_is_written_again(spark, prices, monkeypatch, step):
    """Wherever a batch stops, running it again gives the table of its log."""
    rows = price_rows(spark, (7, 70, "2024-01-03"), (1, 12, "2024-01-01"))
    real = LakeTable._overwrite

    def lost(table, out, target, parts):
        if step == "log" and target == table.log_path:
            raise RuntimeError("lost")
        if target == table.state_path:
            if step == "in the merge":
                # Spark removes the old folders of the partitions before it puts the new ones in their place.
                shutil.rmtree(f"{table.path}/state/day=2024-01-01")
            raise RuntimeError("lost")
        real(table, out, target, parts)

    monkeypatch.setattr(LakeTable, "_overwrite", lost)
    with pytest.raises(RuntimeError):
        prices.commit(rows, batch="q-0")
    monkeypatch.undo()
    assert prices.commit(rows, batch="q-0") == 4
    assert state(prices.read()) == state(prices.read(version=4)) == [(1, 12), (3, 30), (7, 70)]
    assert prices.changes(3).count() == 2


def test_a_table_is_rebuilt_from_its_log(spark, prices):
    expected = state(prices.read())
    shutil.rmtree(f"{prices.path}/state")
    prices.rebuild()
    assert state(prices.read()) == expected


def test_a_failed_commit_leaves_no_version(spark, prices):
    broken = price_rows(spark, (8, 80, "2024-01-03")).withColumn("price", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        prices.commit(broken)
    assert prices.latest_version() == 3 and state(prices.read()) == [(1, 11), (3, 30)]
    assert prices.commit(price_rows(spark, (8, 80, "2024-01-03"))) == 4


def test_a_commit_without_rows_leaves_no_version(spark, prices):
    prices.commit(price_rows(spark, (8, 80, "2024-01-03")).limit(0))
    assert prices.latest_version() == 3 and state(prices.read()) == [(1, 11), (3, 30)]


def test_put_back_after_delete(spark, prices):
    prices.commit(price_rows(spark, (2, 22, "2024-01-01")))
    assert state(prices.read()) == [(1, 11), (2, 22), (3, 30)]


@pytest.mark.parametrize("version", [1, 2, 3])
def test_folding_keeps_the_content(spark, prices, version):
    before = {v: state(prices.read(version=v)) for v in range(version, 4)}
    maintenance.fold(prices, version)
    assert sorted(prices.versions()) == list(range(version, 4))
    assert {v: state(prices.read(version=v)) for v in before} == before
    prices.commit(price_rows(spark, (1, 99, "2024-01-01"), (4, 40, "2024-01-04")))
    assert state(prices.read()) == state(prices.read(version=4)) == [(1, 99), (3, 30), (4, 40)]


def test_young_versions_are_kept_unless_asked(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    for i in range(13):
        table.commit(price_rows(spark, (i, i, "2024-01-01")), committed_ms=ms(i))
    now = START + timedelta(days=13)
    assert maintenance.expire_snapshots(table, now, timedelta(days=30), keep_at_least=1) is None
    assert maintenance.expire_snapshots(table, now, timedelta(days=30), keep_at_least=1, keep_at_most=9) == 4


def test_a_follower_reads_every_commit_once(spark, folder):
    """The follower's place is Spark's checkpoint; expiry of an append table takes nothing away from it."""
    spec = TableSpec("log", schema(id=T.LongType(), day=T.DateType()), partition_by=("day",))
    table = LakeTable(spark, spec, f"{folder}/t").create()
    seen = []

    def follow():
        changes = table.follow()
        take = lambda batch, _: seen.append(sorted((r._commit_version, r.id) for r in batch.collect()))
        started(changes, changes.writeStream.foreachBatch(take), RunSettings(f"{folder}/p", None)).awaitTermination()

    follow()
    rows = lambda i: spark.createDataFrame([(i, "2024-01-01")], "id bigint, day string")
    table.commit(rows(1)), table.commit(rows(2))
    follow()
    assert maintenance.expire_snapshots(table, START + timedelta(days=900), keep_at_least=1) is None
    table.commit(rows(3))
    follow()
    follow()
    assert [b for b in seen if b] == [[(1, 1), (2, 2)], [(3, 3)]]


def test_a_batch_of_a_follower_comes_again_after_a_failure(spark, folder, prices):
    seen = []

    def take(batch, number):
        seen.append((number, batch.count()))
        if len(seen) == 1:
            raise RuntimeError("lost")

    def follow():
        changes = prices.follow()
        query = started(changes, changes.writeStream.foreachBatch(take), RunSettings(f"{folder}/p", None))
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        follow()
    prices.commit(price_rows(spark, (9, 9, "2024-01-01")))
    follow()
    assert seen == [(0, 5), (0, 5), (1, 1)]


def test_compaction_leaves_fewer_files(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    for i in range(3):
        table.commit(price_rows(spark, (i, i, "2024-01-01"), (i, i, "2024-01-02")))
    # As from a writer that does not bring rows together, and a day with nothing but deletes.
    state_rows = table._state().drop("_commit_ts").where("day = DATE '2024-01-01'")
    shutil.copytree(f"{table.path}/state/day=2024-01-01", f"{folder}/copy")
    spark.createDataFrame(state_rows.collect(), state_rows.schema).repartition(3, "id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table.state_path)
    table.delete_where(F.col("day") == "2024-01-02")
    assert maintenance.files(table).where("file_path LIKE '%2024-01-01%'").count() > 1
    assert maintenance.compact_if_needed(table) == 2
    assert maintenance.files(table).count() == 1 and maintenance.files(table).first().row_count == 3
    assert os.listdir(f"{table.path}/state") != [] and not os.path.exists(f"{table.path}/state/day=2024-01-02")
    assert table.read().count() == 3 and maintenance.compact_if_needed(table) is None
    table.commit(price_rows(spark, (9, 9, "2024-01-02")))
    assert state(table.read()) == state(table.read(version=5)) == [(0, 0), (1, 1), (2, 2), (9, 9)]


def test_expiry_keeps_every_kept_version(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    for i in range(20):
        table.commit(price_rows(spark, (i % 5, i, "2024-01-01")), committed_ms=ms(i))
    before = {v: state(table.read(version=v)) for v in range(1, 21)}
    now = START + timedelta(days=19, hours=1)
    # 7 days keep versions of day 13 on; ten versions are kept in any case.
    assert maintenance.expire_snapshots(table, now) == 10
    assert sorted(table.versions()) == list(range(10, 21))
    for v in range(10, 21):
        assert state(table.read(version=v)) == before[v]
    with pytest.raises(ValueError, match="no longer keeps"):
        table.read(version=9)
    with pytest.raises(ValueError, match="no longer keeps"):
        table.read(as_of="2024-01-03 00:00:00")
    with pytest.raises(ValueError, match="no longer keeps"):
        table.changes(5, 12)
    assert maintenance.expire_snapshots(table, now) is None
    assert maintenance.expire_snapshots(table, now, keep_at_least=2, keep_at_most=4) == 16
    assert state(table.read()) == before[20]


def day_rows(spark, *rows):
    return spark.createDataFrame(rows, "id bigint, price bigint, day string")


def test_a_commit_writes_touched_partitions_only(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    table.commit(day_rows(spark, *[(i, i, day) for day in days for i in range(3)]), committed_ms=ms(0))

    def written():
        return {day: sorted(os.listdir(f"{table.path}/state/day={day}")) for day in days}

    before = written()
    table.commit(day_rows(spark, (1, 100, days[2])), committed_ms=ms(1))
    table.delete_where(F.col("day") == days[4], committed_ms=ms(2))
    after = written()
    assert [day for day in days if before[day] != after[day]] == [days[2], days[4]]
    expected = state(table.read())
    assert len(expected) == 21 and expected == state(table.read(version=3))
    assert "Exchange" not in explain(table.read())
    before = [state(table.read(version=v)) for v in (1, 2, 3)]
    assert [len(b) for b in before] == [24, 24, 21]
    now = START + timedelta(days=30)
    assert maintenance.expire_snapshots(table, now, keep_at_least=1) == 2
    assert state(table.read()) == expected and state(table.read(version=2)) == before[1] and state(table.read(version=3)) == expected
    with pytest.raises(ValueError, match="no longer keeps"):
        table.read(version=1)
    table.commit(day_rows(spark, (9, 9, days[0])), committed_ms=ms(4))
    assert maintenance.expire_snapshots(table, now, keep_at_least=1) == 3
    assert state(table.read(version=3)) == expected and sorted(table.versions()) == [3, 4]


def test_deletes_in_an_append_table(spark, folder):
    spec = TableSpec("log", schema(id=T.LongType(), day=T.DateType()), partition_by=("day",))
    table = LakeTable(spark, spec, f"{folder}/log").create()
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 4}") for i in range(40)], "id bigint, day string")
    table.commit(rows)
    table.commit(rows.where("id < 1"))
    table.delete_where(F.col("id") % 4 == 1)
    table.delete_where(F.col("id") == 2)
    expected = sorted([(i,) for i in range(40) if i % 4 != 1 and i != 2] + [(0,)], key=repr)
    assert rows_of(table.read(), "id") == expected
    assert table.read(version=2).count() == 41


def test_partition_names_with_special_characters(spark, folder):
    spec = TableSpec("t", schema(name=T.StringType(), n=T.LongType()), ("name",), partition_by=("name",))
    table = LakeTable(spark, spec, f"{folder}/t").create()
    names = ["a/b", "c=d", "e f", "%", None]
    table.commit(spark.createDataFrame([(n, 1) for n in names], "name string, n bigint"))
    table.commit(spark.createDataFrame([("a/b", 2), (None, 3)], "name string, n bigint"))
    maintenance.fold(table, 2)
    maintenance.compact(table)
    assert rows_of(table.read(), "name", "n") == sorted(
        [("a/b", 2), ("c=d", 1), ("e f", 1), ("%", 1), (None, 3)], key=repr)


def test_delete_in_an_append_table(spark, folder):
    spec = TableSpec("log", schema(id=T.LongType(), day=T.DateType()), partition_by=("day",))
    table = LakeTable(spark, spec, f"{folder}/log").create()
    rows = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "id bigint, day string")
    table.commit(rows)
    assert table.read().count() == 3
    table.delete_where(F.col("id") == 2)
    table.commit(rows.where("id = 2"))
    assert rows_of(table.read(), "id") == [(1,), (1,), (2,)]
    assert table.read(version=1).count() == 3 and table.read(version=2).count() == 2
    assert rows_of(table.changes(1, 2), "id", "_op") == [(2, "D")]


def test_partition_filter_reaches_the_files(prices):
    for read in (prices.read(), prices.read(version=2)):
        plan = explain(read.where("day = DATE '2024-01-02'"))
        scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
        assert scans and all("day" in line for line in scans)


def test_present_rows_are_read_without_a_shuffle(prices):
    assert "Exchange" not in explain(prices.read())


def test_retention_follows_its_configuration(spark, folder):
    catalog = Catalog(spark, f"{folder}/warehouse")
    catalog.create_database("lake_test")
    catalog.use("lake_test")
    summary = catalog.create_table("user_behavior_summary")
    profiles = catalog.create_table("user_profile")
    stats = catalog.create_table("product_sales_stats")
    config = catalog.create_table("data_cleanup_config")
    config.commit(spark.sql("""SELECT * FROM VALUES ('user_behavior_summary', 7, true),
        ('user_profile', 365, true), ('product_sales_stats', 1, false)
        AS t(table_name, retention_days, cleanup_enabled)""").withColumn(
            "last_cleanup_time", F.lit(None).cast("timestamp")))
    starts = spark.sql("""SELECT explode(sequence(TIMESTAMP '2024-01-01 00:00:00',
        TIMESTAMP '2024-01-30 00:00:00', INTERVAL 1 DAY)) AS window_start""")
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in summary.spec.schema.fields}
    summary.commit(starts.withColumns({**nulls, "user_id": F.lit(1), "behavior_type": F.lit("view"),
                                       "window_start": F.col("window_start")}))
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in stats.spec.schema.fields}
    stats.commit(starts.withColumns({**nulls, "product_id": F.lit(1), "window_start": F.col("window_start")}))
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in profiles.spec.schema.fields}
    profiles.commit(spark.sql("""SELECT * FROM VALUES (1L, TIMESTAMP '2022-12-31 00:00:00'),
        (2L, TIMESTAMP '2023-06-01 00:00:00') AS t(user_id, update_time)""").withColumns(
        {**nulls, "user_id": F.col("user_id"), "update_time": F.col("update_time")}))
    tables = {t.spec.name: t for t in (summary, profiles, stats)}
    done = maintenance.apply_retention(config, tables, "2024-01-30 12:00:00")
    assert summary.read().agg(F.min("window_date").cast("string")).first()[0] == "2024-01-23"
    assert summary.read().count() == 8
    assert rows_of(profiles.read(), "user_id") == [(2,)]
    assert stats.read().count() == 30
    assert rows_of(done.selectExpr("table_name", "last_cleanup_time IS NOT NULL")) == [
        ("product_sales_stats", False), ("user_behavior_summary", True), ("user_profile", True)]
    spark.catalog.setCurrentDatabase("default")


def test_catalog(spark, folder):
    catalog = Catalog(spark, f"{folder}/warehouse")
    catalog.create_database("catalog_test")
    catalog.use("catalog_test")
    table = catalog.create_table("sales_summary")
    assert catalog.create_table("sales_summary").path == table.path
    with pytest.raises(ValueError, match="exists"):
        catalog.create_table("sales_summary", if_not_exists=False)
    described = {r.column_name: r for r in catalog.describe("sales_summary").collect()}
    assert described["sale_date"].is_key and described["sale_date"].is_partition
    assert described["total_revenue"].data_type == "decimal(15,2)"
    assert {r.column_name for r in catalog.describe("user_events").where("is_partition").collect()} == {"event_date"}
    table.commit(spark.sql("""SELECT 'a' AS category, 'n' AS region, DATE '2024-01-01' AS sale_date,
        1.5 AS total_revenue, 1 AS total_quantity, 1 AS order_count, 1.5 AS avg_price"""))
    catalog.register("sales_summary")
    assert spark.sql("SELECT total_revenue FROM sales_summary").first()[0] is not None
    assert "sales_summary" in [r.table_name for r in catalog.show_tables().collect()]
    assert "catalog_test" in [r.database_name for r in catalog.show_databases().collect()]
    assert catalog.show_catalogs().count() >= 1
    # Another database has tables of its own, and no view of the first one.
    catalog.create_database("catalog_other")
    catalog.use("catalog_other")
    assert catalog.show_tables().count() == 0
    assert not spark.catalog.tableExists("sales_summary")
    catalog.create_table("sales_summary")
    catalog.register("sales_summary")
    assert spark.table("sales_summary").count() == 0 and spark.table("catalog_test__sales_summary").count() == 1
    with pytest.raises(ValueError, match="no database"):
        Catalog(spark, f"{folder}/warehouse").table("sales_summary")
    for view in ("sales_summary", "catalog_test__sales_summary", "catalog_other__sales_summary"):
        spark.catalog.dropTempView(view)
    spark.catalog.setCurrentDatabase("default")


def test_a_backup_is_compared_with_its_source(spark, folder, monkeypatch):
    maintenance.backup(spark.range(10), f"{folder}/copy")
    real = maintenance._fingerprint
    read = []
    # The second fingerprint is that of the copy: as if rows had been lost on the way.
    monkeypatch.setattr(maintenance, "_fingerprint", lambda df: real(df.limit(5) if read.append(1) or len(read) == 2 else df))
    with pytest.raises(ValueError, match="not like its source"):
        maintenance.backup(spark.range(20), f"{folder}/copy")
    monkeypatch.undo()
    assert maintenance.restore(spark, f"{folder}/copy").count() == 10


def test_backup_detects_damage(spark, folder):
    maintenance.backup(spark.range(100), f"{folder}/copy")
    assert maintenance.restore(spark, f"{folder}/copy").count() == 100
    spark.range(1).write.mode("append").parquet(f"{folder}/copy/data")
    with pytest.raises(ValueError, match="damaged"):
        maintenance.restore(spark, f"{folder}/copy")


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (10, "b"), (10, "b")], "n int, s string")
    expected = [("n", 4, 0, "1", "10", 3), ("s", 4, 1, "a", "b", 2)]
    columns = ["column_name", "row_count", "null_count", "min_value", "max_value", "distinct_count"]
    assert rows_of(maintenance.column_statistics(df, ["n", "s"], exact=True), *columns) == expected
    assert rows_of(maintenance.column_statistics(df, ["n", "s"]), *columns) == expected


def test_bucketed_tables_join_without_a_shuffle(spark, folder):
    rows = spark.range(1000).selectExpr("id % 50 AS user_id", "id AS amount")
    for name in ("bucketed_a", "bucketed_b"):
        maintenance.write_bucketed(rows, name, "user_id", 4, path=f"{folder}/{name}")
    try:
        a, b = spark.table("bucketed_a").alias("a"), spark.table("bucketed_b").alias("b")
        sums = b.groupBy("user_id").agg(F.sum("amount").alias("total"))
        joined = a.hint("merge").join(sums, "user_id")
        assert "Exchange" not in explain(joined) and joined.count() == 1000
        assert len(glob.glob(f"{folder}/bucketed_a/*.parquet")) == 4
    finally:
        spark.sql("DROP TABLE bucketed_a")
        spark.sql("DROP TABLE bucketed_b")


def test_a_hot_bucket_is_written_by_several_tasks(spark, folder):
    spec = TableSpec("hot", schema(user_id=T.LongType(), note=T.StringType()), bucket_by="user_id",
                     target_file_size="100KB")
    table = LakeTable(spark, spec, f"{folder}/hot").create()
    # One user has all rows; the text does not compress, so the bucket is far above one file.
    table.commit(spark.range(0, 40_000, 1, 8).selectExpr("1 AS user_id", "sha2(cast(id AS string), 256) AS note"))
    sizes = [r.row_count for r in maintenance.files(table).collect()]
    assert len(sizes) > 5 and sum(sizes) == 40_000 and max(sizes) < 20_000


def test_state_is_independent_of_row_order(spark):
    log = spark.createDataFrame(
        [(1, "x", "U", 1, 5), (1, "y", "U", 2, 1), (1, "z", "U", 2, 3), (2, "a", "U", 1, 1), (2, "a", "D", 3, 1)],
        "id int, v string, _op string, _commit_version bigint, seq int").withColumn(
            "_commit_ts", F.lit("2024-01-01").cast("timestamp"))
    for n in (1, 3, 7):
        assert rows_of(changelog.current_state(log.repartition(n), ["id"], ["seq"]), "id", "v") == [(1, "z")]


def test_window_tables_use_day_partitions():
    for name in ("user_behavior_summary", "order_summary", "product_sales_stats", "user_behavior_wide"):
        assert TABLES[name].partition_by == ("window_date",)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_histories_match_a_dictionary(spark, folder, seed):
    """Upserts, deletes, repeated batches, compactions and expiry in any order, against a plain dictionary."""
    draw = random.Random(seed)
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    now, history, last = {}, {}, None
    for step in range(14):
        kind = draw.choice(["upsert", "upsert", "upsert", "delete", "again", "compact", "expire"])
        if kind == "upsert":
            rows = [(draw.randint(0, 4), draw.randint(0, 99), f"2024-01-0{draw.randint(1, 3)}")
                    for _ in range(draw.randint(1, 6))]
            table.commit(day_rows(spark, *rows), committed_ms=ms(step), batch=f"b-{step}")
            last = (rows, f"b-{step}")
            best = {}
            for i, price, day in rows:
                best[i, day] = max(price, best.get((i, day), -1))
            now = {**now, **best}
        elif kind == "delete" and table.latest_version():
            limit = draw.randint(0, 99)
            table.delete_where(F.col("price") < limit, committed_ms=ms(step))
            now = {k: v for k, v in now.items() if v >= limit}
        elif kind == "again" and last and table.version_of_batch(last[1]):
            table.commit(day_rows(spark, *last[0]), batch=last[1])
        elif kind == "compact":
            maintenance.compact(table)
        elif kind == "expire":
            maintenance.expire_snapshots(table, START + timedelta(days=step - 3), timedelta(days=1), 2)
        history[table.latest_version()] = dict(now)
        assert rows_of(table.read().selectExpr("id", "cast(day AS string)", "price")) == sorted(
            [(*k, v) for k, v in now.items()], key=repr), (seed, step)
    readable = 0
    for version, expected in history.items():
        try:
            found = table.read(version=version)
        except ValueError:
            assert version < min(table.versions())
            continue
        readable += 1
        assert rows_of(found.selectExpr("id", "cast(day AS string)", "price")) == sorted(
            [(*k, v) for k, v in expected.items()], key=repr), (seed, version)
    assert readable >= 1




@pytest.mark.parametrize("after", ["writing", "one delete", "all deletes"])
def test_an_expiry_that_stopped_can_be_repeated(spark, folder, monkeypatch, after):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    for i in range(6):
        table.commit(day_rows(spark, (i, i, "2024-01-01")), committed_ms=ms(i))
    before = {v: state(table.read(version=v)) for v in range(4, 7)}
    deleted, real = [], folders.delete

    def stops(spark, path):
        deleted.append(path)
        real(spark, path)
        if len(deleted) == {"writing": 99, "one delete": 1, "all deletes": 4}[after]:
            raise RuntimeError("lost")

    if after == "writing":
        monkeypatch.setattr(maintenance, "finish_folding", lambda table: None)
    else:
        monkeypatch.setattr(folders, "delete", stops)
    try:
        maintenance.fold(table, 4)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert state(table.read()) == before[6]
    assert maintenance.expire_snapshots(table, START + timedelta(days=30), keep_at_least=2) is None
    assert sorted(table.versions()) == [4, 5, 6]
    assert {v: state(table.read(version=v)) for v in before} == before


def test_dropped_days_are_gone_from_all_versions(spark, folder):
    table = LakeTable(spark, PRICES, f"{folder}/t").create()
    table.commit(day_rows(spark, *[(i, i, f"2024-01-0{i}") for i in range(1, 6)]))
    table.commit(day_rows(spark, (1, 10, "2024-01-01"), (5, 50, "2024-01-05")))
    assert maintenance.drop_partitions_before(table, "2024-01-03") == 5
    assert state(table.read()) == state(table.read(version=2)) == [(3, 3), (4, 4), (5, 50)]


def test_times_have_statistics_for_filters(spark, folder):
    table = LakeTable(spark, TABLES["user_events"], f"{folder}/t").create()
    with session_conf(spark, {"spark.sql.parquet.outputTimestampType": "INT96"}):
        table.commit(spark.sql("SELECT 1 AS user_id, 'a' AS event_type, TIMESTAMP '2024-01-01' AS event_time, '' AS properties"))
    file = pq.ParquetFile(maintenance.files(table).first().file_path.removeprefix("file:"))
    column = file.schema_arrow.get_field_index("event_time")
    assert file.metadata.row_group(0).column(column).statistics.has_min_max


def test_a_table_can_become_empty(spark, prices):
    prices.delete_where(F.lit(True))
    maintenance.compact(prices)
    assert prices.read().count() == 0
    prices.commit(price_rows(spark, (1, 1, "2024-01-01")))
    assert state(prices.read()) == [(1, 1)]
