"""Column helpers."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake import functions as fn

prices = st.decimals(min_value=Decimal("-99999999.99"), max_value=Decimal("99999999.99"), places=2)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_averages_are_exact(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(prices, min_size=1, max_size=5), min_size=1, max_size=20))
    def check(groups):
        rows = [(i, p) for i, group in enumerate(groups) for p in group]
        df = spark.createDataFrame(rows, "k int, price decimal(10,2)")
        cents = fn.to_cents("price")
        found = {r.k: (r.total, r.mean) for r in df.groupBy("k").agg(
            fn.from_cents(F.sum(cents)).alias("total"),
            fn.average_of_cents(F.sum(cents), F.count(cents)).alias("mean")).collect()}
        for i, group in enumerate(groups):
            mean = (sum(group) / len(group)).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert found[i] == (sum(group), mean)

    check()


def test_average_of_nothing_is_null(spark):
    assert one(spark, fn.average_of_cents(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))) is None


def test_greatest_or_null(spark):
    assert one(spark, fn.greatest_or_null(F.lit(1), F.lit(3), F.lit(2))) == 3
    assert one(spark, fn.greatest_or_null(F.lit(1), F.lit(None).cast("int"))) is None


def test_threshold_classes(spark):
    values = [(None, None), (69.99, "green"), (70.0, "yellow"), (89.99, "yellow"), (90.0, "red")]
    df = spark.createDataFrame([(v,) for v, _ in values], "v double")
    assert [r.c for r in df.select(fn.threshold_class(F.col("v")).alias("c")).collect()] == [c for _, c in values]


def test_spend_scores(spark):
    for spent, score in [("1000.01", "0.9"), ("1000", "0.7"), ("500.01", "0.7"), ("500", "0.5"), ("0", "0.5")]:
        assert one(spark, fn.spend_score(F.lit(Decimal(spent)))) == Decimal(score)


def test_interval_seconds():
    assert [fn.interval_seconds(t) for t in ("1 minute", "30 minutes", "1 hour", "7 days", "15 seconds")] == [
        60, 1800, 3600, 604800, 15]


def test_moment_takes_the_type_of_the_column(spark):
    zoned = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS ts")
    plain = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts")
    for df in (zoned, plain):
        assert df.where(fn.since(df, "ts", "2024-01-01 00:30:00", "30 minutes")).count() == 1
        assert df.where(fn.since(df, "ts", "2024-01-01 00:30:01", "30 minutes")).count() == 0
        assert df.where(fn.since(df, "ts", None, "1 hour")).count() == 0
