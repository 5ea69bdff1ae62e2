"""As-of joins, values at steps, mergeable distinct counts, bounds of equal height, payloads, pruning at run time."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tarnlake.lake.catalog import explain
from tarnlake.operators import as_of_join, bitmaps, histogram, timeseries
from tarnlake.plans import behavior, payloads, sales

START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


# --- as-of join -----------------------------------------------------------------------------------

@pytest.mark.parametrize("slice_,at_most", [("1 minute", None), ("1 hour", None), ("10 seconds", "90 seconds"), ("1 day", "3 minutes")])
def test_as_of_join_equals_a_search_per_row(spark, slice_, at_most):
    draw = random.Random(len(slice_))
    rows = [(n, draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, *range(0, 4000)])) for n in range(400)]
    versions = [(draw.choice([1, 1, 2, None]), draw.choice([None, *range(0, 4000, 10)]), f"v{n}") for n in range(150)]
    best = {}
    for key, second, name in versions:
        if key is not None and second is not None:
            best.setdefault(key, {})[second] = max(name, best.get(key, {}).get(second, ""))
    limit = None if at_most is None else int(at_most.split()[0]) * (60 if "minute" in at_most else 1)
    expected = []
    for n, key, second in rows:
        known = sorted(s for s in best.get(key, {}) if second is not None and s <= second)
        held = known and (limit is None or second - known[-1] < limit)
        expected.append((n, best[key][known[-1]] if held else None))
    left = spark.createDataFrame([(n, key, at(s)) for n, key, s in rows], "n int, key int, t timestamp_ntz")
    right = spark.createDataFrame([(key, at(s), name) for key, s, name in versions], "key int, since timestamp_ntz, name string")
    found = as_of_join(left, right, ["key"], "t", "since", ["name"], slice_, at_most)
    assert found.columns == ["n", "key", "t", "name"]
    assert rows_of(found, "n", "name") == sorted(expected, key=repr)


def test_as_of_join_without_versions_or_rows(spark):
    left = spark.createDataFrame([(1, at(5))], "key int, t timestamp_ntz")
    right = spark.createDataFrame([], "key int, since timestamp_ntz, name string")
    assert rows_of(as_of_join(left, right, ["key"], "t", "since", ["name"]), "key", "name") == [(1, None)]
    assert as_of_join(left.limit(0), right, ["key"], "t", "since", ["name"]).count() == 0


def test_a_hot_key_of_an_as_of_join_is_many_groups(spark):
    """All windows over rows are by key and slice; the one by key alone sees a row per slice."""
    left = spark.range(100_000).selectExpr("1 AS key", "timestamp_seconds(1704067200 + id) AS t")
    right = spark.range(100).selectExpr("1 AS key", "timestamp_seconds(1704067200 + id * 977) AS since", "id AS name")
    plan = explain(as_of_join(left, right, ["key"], "t", "since", ["name"], "10 minutes"))
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line and "Arguments" in line]
    assert windows and all("_slice" in line for line in windows)
    found = as_of_join(left, right, ["key"], "t", "since", ["name"], "10 minutes")
    assert found.groupBy("name").count().count() == 100


# --- steps ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("step,look_back,slice_", [(7, 60, "1 minute"), (60, 5, "10 seconds"), (30, 300, "1 hour"), (13, 900, "2 minutes")])
def test_values_at_steps(spark, step, look_back, slice_):
    draw = random.Random(step)
    samples = [(draw.choice("aab"), draw.choice([*range(-400, 4000)]), float(draw.randint(0, 9))) for _ in range(200)]
    samples += [("c", 10, 1.0), ("c", 10, 2.0), ("c", 5000, 3.0)]
    rows = [("m", {"job": job}, at(s), v) for job, s, v in samples] + [("m", {"job": "a"}, at(50), None), ("other", {"job": "z"}, at(1), 1.0)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    expected, all_steps = [], []
    for job in "abc":
        own = {}
        for j, s, v in samples:
            if j == job:
                own[s] = max(v, own.get(s, v))
        times = sorted(own)
        for t in range(0, 3601, step):
            place = bisect.bisect_right(times, t)
            value = own[times[place - 1]] if place and t - times[place - 1] <= look_back else None
            all_steps.append((job, at(t), value))
            if value is not None:
                expected.append((job, at(t), value))
    of = lambda df: rows_of(df.select(F.col("labels")["job"].alias("job"), "ts", "value"))
    args = (df, "m", str(START), str(at(3600)), f"{step} seconds", f"{look_back} seconds", slice_)
    assert of(timeseries.at_steps(*args)) == sorted(expected, key=repr)
    assert of(timeseries.at_steps(*args, gaps=True)) == sorted(all_steps, key=repr)


# --- bitmaps --------------------------------------------------------------------------------------

def test_distinct_counts_from_merged_bitmaps(spark):
    draw = random.Random(3)
    ids = [None, 0, -1, -40000, 1, 32768, 32769, 10**12, *range(100, 130)]
    rows = [(draw.choice("ab"), at(draw.randrange(0, 86400 * 3)), draw.choice(ids)) for _ in range(900)]
    df = spark.createDataFrame(rows, "event_type string, event_time timestamp_ntz, user_id long")
    hourly = behavior.user_bitmaps(df)
    twice = hourly.unionAll(hourly)  # or-ing a bitmap again changes no distinct count
    for unit, start in (("hour", lambda t: t.replace(minute=0, second=0)), ("day", lambda t: t.replace(hour=0, minute=0, second=0))):
        seen = {}
        for kind, t, user in rows:
            group = seen.setdefault((kind, start(t)), [set(), 0])
            group[1] += 1
            if user is not None:
                group[0].add(user)
        expected = sorted(((*k, len(users), n) for k, (users, n) in seen.items()), key=repr)
        assert rows_of(behavior.distinct_users(hourly, unit), "event_type", "period_start", "user_count", "event_count") == expected
        assert [r[2] for r in rows_of(behavior.distinct_users(twice, unit), "event_type", "period_start", "user_count")] == [r[2] for r in expected]


def test_bitmaps_are_built_on_the_map_side(spark):
    plan = explain(bitmaps.id_bitmaps(spark.range(10), {"one": F.lit(1)}, "id"))
    assert "partial_bitmap_construct_agg" in plan


# --- bounds ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("buckets", [1, 4, 10, 64])
def test_bounds_of_equal_height(spark, buckets):
    draw = random.Random(buckets)
    rows = [(7 if draw.random() < 0.4 else draw.randint(-50, 50), None if draw.random() < 0.2 else draw.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, b double").repartition(5)
    expected = []
    for name, values in (("a", [a for a, _ in rows]), ("b", [b for _, b in rows if b is not None])):
        values = sorted(map(float, values))
        for bucket in range(1, buckets + 1):
            upper = values[-(-bucket * len(values) // buckets) - 1]
            expected.append((name, bucket, upper, bisect.bisect_right(values, upper)))
    assert rows_of(histogram.equi_height(df, ["a", "b"], buckets)) == sorted(expected, key=repr)


def test_bounds_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a int")
    assert histogram.equi_height(df, ["a"]).count() == 0 and histogram.equi_height(df.limit(0), ["a"]).count() == 0


# --- payloads -------------------------------------------------------------------------------------

PAYLOADS = [
    ("a", '{"x": 1, "y": {"z": [1, 2]}}'), ("a", '{"x": "one", "y": null}'), ("a", '{"x": 1.5}'), ("a", "{broken"), ("a", None),
    ("b", "[1]"), ("b", "7"), ("b", '{}'), ("b", '{"ok": true}'), (None, '{"x": 2}'),
]


def test_shapes_of_payloads(spark):
    df = spark.createDataFrame(PAYLOADS, "kind string, body string")
    assert rows_of(payloads.payload_shapes(df, "kind", "body")) == sorted([
        ("a", "x", "number", 2), ("a", "x", "string", 1), ("a", "y", "object", 1), ("a", "y", "null", 1),
        ("a", None, "malformed", 1), ("a", None, "null", 1), ("b", None, "no object", 2), ("b", "ok", "boolean", 1),
        (None, "x", "number", 1)], key=repr)


def test_schemas_and_values_of_payloads(spark):
    df = spark.createDataFrame(PAYLOADS, "kind string, body string")
    schemas = {r.kind: (r.payload_schema, r.malformed) for r in payloads.payload_schemas(df, "kind", "body").collect()}
    assert schemas["a"] == ("OBJECT<x: VARIANT, y: OBJECT<z: ARRAY<BIGINT>>>", 1) and schemas["b"][1] == 0
    found = payloads.payload_values(df, "body", {"x": ("$.x", "bigint"), "second": ("$.y.z[1]", "int")})
    assert found.columns == ["kind", "body", "x", "second"]
    assert [(r.x, r.second) for r in found.collect()][:2] == [(1, 2), (None, None)]


# --- pruning at run time --------------------------------------------------------------------------

def test_only_the_folders_of_the_days_are_read(spark, folder):
    rows = spark.range(3000).selectExpr(
        "id", "'p' AS product_name", "'c' AS category", "CAST(1 AS decimal(10,2)) AS price",
        "date_add(DATE '2024-01-01', CAST(id % 30 AS int)) AS sale_date")
    sales.write_by_day(rows, f"{folder}/sales")
    events = spark.range(60).selectExpr(
        "id AS user_id", "CASE WHEN id < 2 THEN 'purchase' ELSE 'view' END AS event_type",
        "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(CAST(id % 30 AS int)) AS event_time",
        "date_add(DATE '2024-01-01', CAST(id % 30 AS int)) AS event_date")
    events.write.parquet(f"{folder}/events")
    found = sales.purchase_sales_of_days(spark.read.parquet(f"{folder}/events"), spark.read.parquet(f"{folder}/sales"))
    assert "dynamicpruning" in explain(found)
    assert sorted((r.user_id, r.product_name) for r in found.collect()) == [(0, "p"), (1, "p")]
    plan = found._jdf.queryExecution().executedPlan()
    read = {}

    def visit(node):
        name = node.getClass().getSimpleName()
        if name in ("AdaptiveSparkPlanExec", "InputAdapter", "WholeStageCodegenExec") or "QueryStage" in name:
            inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if "QueryStage" in name else node.child()
            visit(inner)
            return
        if name == "FileSourceScanExec" and "sale_date" in node.toString():
            read["files"] = node.metrics().apply("numFiles").value()
        children = node.children()
        for k in range(children.size()):
            visit(children.apply(k))

    visit(plan)
    assert 0 < read["files"] <= 2 * 8
