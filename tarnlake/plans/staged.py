"""Extract, transform and load as three stages with an audit of their row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators import latest_per_key
from tarnlake.sources import messages


def extract(source: DataFrame, path: str) -> None:
    """Keep the messages as they came."""
    source.select("value").write.mode("overwrite").parquet(path)


def transform(spark: SparkSession, raw: str, path: str, schema: T.StructType, event_time: str,
              valid: Column | None = None) -> None:
    """Decode the messages and keep those with an event time that are valid."""
    rows = messages.good_rows(messages.decode(spark.read.parquet(raw), schema), event_time)
    if valid is not None:
        rows = rows.where(valid)
    rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, clean: str, path: str, keys: Sequence[str], order_by: Sequence[str]) -> None:
    """Keep the last row of every key."""
    latest_per_key(spark.read.parquet(clean), keys, order_by).write.mode("overwrite").parquet(path)


def run_stages(
    source: DataFrame,
    folder: str,
    schema: T.StructType,
    event_time: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    valid: Column | None = None,
) -> DataFrame:
    """Run the stages one after the other; returns the audit.

    Every stage writes its result and the next one reads it, so a lost executor never goes back
    further than one stage.
    """
    spark = source.sparkSession
    raw, clean, target = (f"{folder}/{name}" for name in ("raw", "clean", "target"))
    extract(source, raw)
    transform(spark, raw, clean, schema, event_time, valid)
    load(spark, clean, target, keys, order_by)
    return audit(spark, [("extract", raw, raw), ("transform", raw, clean), ("load", clean, target)])


def audit(spark: SparkSession, stages: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows in, rows out and rejected rows of (stage, input, output).

    Counted from the written files, where a repeated task leaves no trace; counters that run along
    with a stage may count its rows again.
    """
    counts = None
    for stage, before, after in stages:
        row = spark.read.parquet(before).agg(F.count("*").alias("rows_in")).select(
            F.lit(stage).alias("stage"),
            "rows_in",
            spark.read.parquet(after).agg(F.count("*")).scalar().alias("rows_out"),
        )
        counts = row if counts is None else counts.unionByName(row)
    return counts.withColumn("rejected", F.col("rows_in") - F.col("rows_out"))
