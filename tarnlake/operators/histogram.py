"""Exact equi-height bounds of columns by a distributed rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import stored


def equi_height(df: DataFrame, columns: Sequence[str], buckets: int = 10) -> DataFrame:
    """``column_name``, ``bucket`` (from 1), ``upper`` (as double) and ``row_count``, for numeric columns.

    Bucket b of B ends at the value whose rank among the column's N values is ceil(b * N / B); equal values may end
    several buckets. NULLs have no rank. ``row_count`` is how many values lie at or below the bound.

    Values are counted first, on the map side, so a value that a third of the rows have is one row. The distinct values are
    dealt into ranges; the sums of the ranges, a number each, give the rank at which every range starts. No task
    sorts more than a range.
    """
    spark = df.sparkSession
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(name).cast("double").alias("value")) for name in columns]))
    counted = df.select(each.alias("of")).select("of.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(
        F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        counted.repartitionByRange(parts, "column_name", "value").withColumn("range", F.spark_partition_id()), "ranges")
    # One row per column and range.
    sums = ranged.groupBy("column_name", "range").agg(F.sum("n").alias("of_range"))
    by_column = Window.partitionBy("column_name").orderBy("range")
    starts = sums.select(
        "column_name", "range",
        (F.sum("of_range").over(by_column) - F.col("of_range")).alias("start"),
        F.sum("of_range").over(Window.partitionBy("column_name")).alias("total"))
    within = Window.partitionBy("column_name", "range").orderBy("value")
    ranked = ranged.join(starts, ["column_name", "range"]).withColumn("upto", F.col("start") + F.sum("n").over(within))
    # The buckets whose last rank, ceil(b * total / buckets), this value holds.
    first = F.expr(f"(upto - n) * {buckets} DIV total + 1")
    last = F.expr(f"upto * {buckets} DIV total")
    return ranked.where(last >= first).select(
        "column_name", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("bucket"), F.col("value").alias("upper"),
        F.col("upto").alias("row_count"))
