"""Grouping operators that combine on the map side, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order_by`` values of every key; NULL counts as smallest.

    Written as an aggregate and not as ``row_number()``: each task keeps one row per key before the
    shuffle, where a window would send every row of a hot key to one task. Equal ``order_by``
    values are decided by the remaining columns, so the result does not depend on row order.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ordered = [c for c in order_by if c not in keys]
    if not ordered and not rest:
        return df.distinct()
    fields = {f.name: f.dataType for f in df.schema.fields}
    comparable = [c for c in rest if not _has_map(fields[c])]
    if len(comparable) == len(rest):
        winner = F.max(F.struct(*ordered, *rest))
    else:
        winner = F.max_by(F.struct(*ordered, *rest), F.struct(*ordered, *comparable))
    return df.groupBy(*keys).agg(winner.alias("_winner")).select(
        *[F.col(c) if c in keys else F.col(f"_winner.`{c}`").alias(c) for c in df.columns]
    )


def _has_map(data_type: T.DataType) -> bool:
    return "map<" in data_type.simpleString()


def distinct_per_group(
    df: DataFrame,
    groups: Mapping[str, Column],
    value: str,
    distinct_name: str,
    count_name: str,
) -> DataFrame:
    """Exact number of distinct ``value`` next to the number of rows, in batch and on streams.

    Streams reject COUNT(DISTINCT). Counting rows per (group, value) first and then counting values
    per group gives the same numbers with two ordinary aggregates. The first shuffle is on group
    and value, so one large group is spread over the cluster. NULL values count as rows but not as
    a distinct value. On a stream both steps run in append mode: a window appears once the
    watermark has passed it.
    """
    per_value = df.groupBy(*[c.alias(name) for name, c in groups.items()], value).agg(
        F.count("*").alias("_rows")
    )
    return per_value.groupBy(*groups).agg(
        F.count(value).alias(distinct_name), F.sum("_rows").alias(count_name)
    )


def top_rows(df: DataFrame, by: Column, tie_break: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows by ``by``; the tie-break columns make the choice unique.

    Spark keeps ``limit`` rows per task and merges those, so nothing larger reaches one place.
    """
    return df.orderBy(by, *tie_break).limit(limit)


def counted_by(df: DataFrame, keys: Sequence[str], name: str = "row_count") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))
