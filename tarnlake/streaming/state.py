"""What a streaming query keeps in its state, read from its checkpoint with Spark's state data source.

Reading takes no part in the query: it may be running or stopped. A state row is a window (or another key) that the watermark
has not passed yet, so the listing shows what a query would lose without its checkpoint, how far back it can still
change a result, and whether its state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a query: id, name, state store and the batches that can be read."""
    found = spark.read.format("state-metadata").load(checkpoint)
    return found.select("operatorId", "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId")


def rows_in_state(
    spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None, store: str | None = None,
) -> DataFrame:
    """``key`` and ``value`` of every row in an operator's state, after the last batch or an earlier one."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    if store is not None:
        reader = reader.option("storeName", store)
    return reader.load(checkpoint)


def windows_in_state(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """The windows an aggregate still keeps, with the other grouping columns under their own names.

    The columns of a group's partial results are added as ``value``.
    """
    rows = rows_in_state(spark, checkpoint, operator, batch_id)
    fields = rows.schema["key"].dataType.fieldNames()
    window = next(name for name in fields if name.split("-")[0] == "window")
    others = [F.col(f"key.`{name}`").alias(name) for name in fields if name != window]
    return rows.select(
        *others, F.col(f"key.`{window}`.start").alias("window_start"), F.col(f"key.`{window}`.end").alias("window_end"), "value")


def state_by_partition(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Rows per state partition: one that has far more than the others holds a hot key."""
    return rows_in_state(spark, checkpoint, operator).groupBy("partition_id").agg(F.count("*").alias("state_rows"))
