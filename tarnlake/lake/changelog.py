"""Reads over a change log: rows with ``_op`` ('U' or 'D'), ``_commit_version`` and ``_commit_ts``.

The log holds the input rows as they came. What a table contains is an expression over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.moments import AsOf, moment
from tarnlake.operators import latest_per_key

UPSERT, DELETE = "U", "D"
LOG_COLUMNS = ("_op", "_commit_version", "_commit_ts")


def last_changes(log: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The last change of every key: highest version, then ``order_by``, then remaining columns."""
    return latest_per_key(log, keys, ["_commit_version", *order_by])


def without_log_columns(rows: DataFrame) -> DataFrame:
    return rows.drop(*LOG_COLUMNS)


def current_state(log: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The last row of every key that was not deleted."""
    last = last_changes(log, keys, order_by)
    return without_log_columns(last.where(F.col("_op") != DELETE))


def not_deleted(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of a log without keys: those that no later version has deleted, with their repeats."""
    added = log.where(F.col("_op") == UPSERT).alias("added")
    gone = log.where(F.col("_op") == DELETE).select(*columns, "_commit_version").distinct()
    if gone.isEmpty():
        return added.select(*columns)
    later = F.col("gone._commit_version") > F.col("added._commit_version")
    for column in columns:
        later = later & F.col(f"added.{column}").eqNullSafe(F.col(f"gone.{column}"))
    return added.join(gone.alias("gone"), later, "left_anti").select(*columns)


def upto_version(log: DataFrame, version: int) -> DataFrame:
    return log.where(F.col("_commit_version") <= version)


def upto_time(log: DataFrame, as_of: AsOf) -> DataFrame:
    return log.where(F.col("_commit_ts") <= moment(as_of, log.schema["_commit_ts"].dataType))


def between_versions(log: DataFrame, after: int, upto: int) -> DataFrame:
    """The changes of the versions ``after < version <= upto``."""
    return log.where((F.col("_commit_version") > after) & (F.col("_commit_version") <= upto))


def snapshots(log: DataFrame) -> DataFrame:
    """Commit time and number of changes per version."""
    return log.groupBy("_commit_version").agg(
        F.max("_commit_ts").alias("committed_at"),
        F.count("*").alias("changes"),
        F.count(F.when(F.col("_op") == UPSERT, 1)).alias("upserts"),
        F.count(F.when(F.col("_op") == DELETE, 1)).alias("deletes"),
    )


def delete_changes(state: DataFrame, condition) -> DataFrame:
    """Change rows that delete the rows of ``state`` for which the condition is true."""
    return state.where(condition).withColumn("_op", F.lit(DELETE))
