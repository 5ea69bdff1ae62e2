"""Metric queries against plain Python."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from tarnlake.operators import timeseries
from tarnlake.plans import dashboards, logs
from tarnlake.session import session_conf

START = datetime(2024, 1, 1)
SCHEMA = "metric string, labels map<string,string>, ts timestamp_ntz, value double"


def samples(spark, points):
    """Points (series, second, value) of one counter."""
    return spark.createDataFrame(
        [("c", {"job_name": s, "host": "h"}, START + timedelta(seconds=t), v) for s, t, v in points], SCHEMA)


def rate_of(points, width=300):
    found = {}
    for series in {p[0] for p in points}:
        own = sorted((t, v) for s, t, v in points if s == series)
        for t, _ in own:
            inside = [(a, v) for a, v in own if t - width <= a <= t]
            if len(inside) < 2:
                continue
            gained = sum(v if v < w else v - w for (_, w), (_, v) in zip(inside, inside[1:]))
            found[series, t] = gained / (inside[-1][0] - inside[0][0])
    return found


def check_rate(spark, points, slice_="1 hour"):
    found = {
        (r.labels["job_name"], int((r.ts - START).total_seconds())): r.value
        for r in timeseries.rate(samples(spark, points), "c", "5 minutes", slice_).collect()
    }
    assert found == pytest.approx(rate_of(points))


def test_rate_on_a_grid_with_restarts(spark):
    points = [("a", 15 * i, float((i * 7) % 97)) for i in range(1000)]
    points += [("b", 15 * i, float(i % 240)) for i in range(500)]
    check_rate(spark, points)
    check_rate(spark, points, "5 minutes")


def test_rate_of_sparse_samples(spark):
    check_rate(spark, [("a", 0, 1.0), ("a", 300, 5.0), ("a", 601, 9.0), ("a", 3599, 1.0), ("a", 3601, 2.0)])


def test_rate_of_any_samples(spark):
    point = st.tuples(st.sampled_from("abc"), st.integers(0, 9000), st.integers(0, 50).map(float))

    @settings(max_examples=15, deadline=None)
    @given(st.lists(point, min_size=1, max_size=60, unique_by=lambda p: p[:2]))
    def check(points):
        check_rate(spark, points)

    check()


def test_rate_does_not_need_one_task_per_series(spark):
    """One series holds all samples; its windows are spread over the shuffle partitions."""
    points = spark.range(100_000).select(
        F.lit("c").alias("metric"), F.create_map(F.lit("job_name"), F.lit("a")).alias("labels"),
        F.timestamp_micros(F.col("id") * 15_000_000).cast("timestamp_ntz").alias("ts"),
        F.col("id").cast("double").alias("value"))
    rated = timeseries.rate(points, "c").withColumn("task", F.spark_partition_id())
    with session_conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sizes = [r["count"] for r in rated.groupBy("task").count().collect()]
    assert sum(sizes) == 99_999 and len(sizes) >= 6 and max(sizes) < 40_000
    assert rated.where("abs(value - 1/15D) > 1e-9").count() == 0


def test_percent_is_null_for_a_zero_whole(spark):
    rows = [("used", {"j": "a"}, START, 5.0), ("max", {"j": "a"}, START, 0.0),
            ("used", {"j": "b"}, START, 9.0), ("max", {"j": "b"}, START, 10.0),
            ("used", {"j": "c"}, START, 9.0)]
    found = timeseries.with_threshold(timeseries.percent_of(spark.createDataFrame(rows, SCHEMA), "used", "max"))
    assert {(r.labels["j"], r.value, r.level) for r in found.collect()} == {("a", None, None), ("b", 90.0, "red")}


def test_latest_and_grid(spark):
    df = samples(spark, [("a", 0, 1.0), ("a", 14, 2.0), ("a", 15, 3.0), ("b", 31, 4.0)])
    latest = {r.labels["job_name"]: r.value for r in timeseries.latest_samples(df, "c").collect()}
    assert latest == {"a": 3.0, "b": 4.0}
    before = timeseries.latest_samples(df, "c", START + timedelta(seconds=14)).collect()
    assert [r.value for r in before] == [2.0]
    grid = timeseries.on_grid(df, "c").collect()
    assert sorted((r.labels["job_name"], (r.ts - START).seconds, r.value) for r in grid) == [
        ("a", 0, 2.0), ("a", 15, 3.0), ("b", 30, 4.0)]


def test_label_order_does_not_matter(spark):
    rows = [("c", {"x": "1", "y": "2"}, START, 1.0), ("c", {"y": "2", "x": "1"}, START + timedelta(seconds=1), 2.0)]
    assert timeseries.latest_samples(spark.createDataFrame(rows, SCHEMA), "c").count() == 1


def test_legend(spark):
    df = samples(spark, [("a", 0, 1.0)])
    texts = ["Records In - {{job_name}}", "{{ host }}/{{none}}.", "plain"]
    found = df.select(*[timeseries.legend(t).alias(str(i)) for i, t in enumerate(texts)]).first()
    assert tuple(found) == ("Records In - a", "h/.", "plain")


def test_every_panel_runs(spark):
    panels = dashboards.STREAM_PANELS + dashboards.LAKE_PANELS
    assert len(panels) == 27
    # Two exporters write the metrics of the first dashboard.
    prefixes = {"manager": "m_", "worker": "w_", "lake": "l_"}
    assert {p.exporter for p in dashboards.STREAM_PANELS} == {"manager", "worker"}
    names = sorted({prefixes[p.exporter] + m for p in panels for m in (p.metric, p.whole) if m})
    rows = [(name, {"job_name": "j", "table_name": "t"}, START + timedelta(seconds=15 * i),
             (200.0 if "Max" in name or "total_bytes" in name else 10.0) + 3 * i)
            for name in names for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = [10.0, 13.0, 16.0, 19.0]
    values = {"latest": [19.0], "percent": [v / (190 + v) * 100 for v in first], "rate": [0.2] * 3, "range": first}
    for panel in panels:
        found = dashboards.panel_query(df, panel, START + timedelta(minutes=2), prefixes=prefixes).collect()
        got = sorted(r.value - (190 if "Max" in panel.metric else 0) for r in found)
        assert got == pytest.approx(values[panel.kind]), panel
        assert found[0].legend and "{{" not in found[0].legend


def test_latest_samples_of_a_look_back(spark):
    df = samples(spark, [("a", 0, 1.0), ("b", 7000, 2.0)])
    now = START + timedelta(seconds=7200)
    assert timeseries.latest_samples(df, "c", now).count() == 2
    assert [r.value for r in timeseries.latest_samples(df, "c", now, "1 hour").collect()] == [2.0]


def test_log_scan_lists_quiet_services(spark):
    lines = spark.createDataFrame(
        [("a", START, "Some ERROR"), ("a", START, "an Exception"), ("a", START - timedelta(hours=2), "failed"),
         ("b", START, "fine")], "service string, ts timestamp_ntz, line string")
    services = spark.createDataFrame([("a",), ("b",), ("c",)], "service string")
    assert rows_of(logs.error_scan(lines, services, START)) == [("a", 2, "WARN"), ("b", 0, "OK"), ("c", 0, "OK")]


def test_latest_events_and_rollup(spark):
    rows = [("n", f"pod{i}", "Running" if i % 3 else "Pending", START + timedelta(seconds=i),
             "Warning: back-off" if i % 10 == 0 else "BackOff restarting" if i % 7 == 0 else "ok") for i in range(100)]
    df = spark.createDataFrame(rows, "namespace string, name string, status string, last_ts timestamp_ntz, message string")
    assert [r.name for r in logs.latest_events(df, 3).collect()] == ["pod99", "pod98", "pod97"]
    assert [r.name for r in logs.latest_events(df, 2, logs.ERROR_EVENTS).collect()] == ["pod98", "pod91"]
    assert logs.latest_events(df, 20, logs.WARNING_EVENTS).count() == 10
    assert rows_of(logs.status_rollup(df)) == [("n", 66, 100)]
    assert logs.problem_items(df).count() == 34
