"""As-of join: to every row the last version of its key at or before the row's time.

A product that sells in every second may have a third of all orders. So a key is cut into slices of time, and
each slice is a group of its own, with one row more: the last version before it, carried in. To find that, every
slice is first reduced to its last version on the map side; only these, one per key and slice, are looked at in the
order of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import interval_seconds


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def as_of_join(
    rows: DataFrame,
    versions: DataFrame,
    on: Sequence[str],
    time: str,
    version_time: str,
    columns: Sequence[str],
    slice_: str = "1 hour",
    at_most: str | None = None,
) -> DataFrame:
    """``rows`` with ``columns`` of the version of their key (columns ``on``) that holds at ``time``.

    A version holds from its own time on until the next one of its key, or, with ``at_most``, for less than that long. Rows
    whose key has no version yet, or whose key or time is NULL, get NULLs. Of versions of one key and time the
    greatest counts, in the order of ``columns``, which must be comparable. ``columns`` may not be among those of ``rows``.
    """
    span = interval_seconds(slice_) * 1_000_000
    keys = [f"_key{n}" for n in range(len(on))]

    def keyed(df: DataFrame, at: str) -> list[Column]:
        moment = _micros(df[at])
        return [*[df[name].alias(key) for name, key in zip(on, keys)], moment.alias("_at"),
                F.floor(moment / F.lit(span)).cast("long").alias("_slice")]

    known = F.lit(True)
    for key in [*keys, "_at"]:
        known = known & F.col(key).isNotNull()
    version = F.struct(F.col("_at").alias("at"), F.struct(*[F.col(c) for c in columns]).alias("of"))
    changed = versions.select(*keyed(versions, version_time), *[versions[c] for c in columns]).where(known).select(
        *keys, "_at", "_slice", version.alias("_version")).groupBy(*keys, "_slice", "_at").agg(F.max("_version").alias("_version"))
    asked = rows.select(*keyed(rows, time), F.struct(*[rows[c] for c in rows.columns]).alias("_row"))

    # Per key and slice: its last version, if any; then the last one of all slices before it.
    of_slice = changed.groupBy(*keys, "_slice").agg(F.max("_version").alias("_version"))
    nothing = F.lit(None).cast(changed.schema["_version"].dataType)
    wanted = asked.where(known).select(*keys, "_slice").distinct().withColumn("_version", nothing)
    slices = of_slice.unionByName(wanted).groupBy(*keys, "_slice").agg(F.max("_version").alias("_version"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.last("_version", True).over(before).alias("_version")).where("_version IS NOT NULL")

    no_row = F.lit(None).cast(asked.schema["_row"].dataType)
    events = (
        asked.where(known).select(*keys, "_slice", "_at", F.lit(1).alias("_kind"), "_row", nothing.alias("_version"))
        .unionByName(changed.select(*keys, "_slice", "_at", F.lit(0).alias("_kind"), no_row.alias("_row"), "_version"))
        .unionByName(carried.select(
            *keys, "_slice", (F.col("_slice") * span - 1).alias("_at"), F.lit(0).alias("_kind"), no_row.alias("_row"), "_version")))
    so_far = Window.partitionBy(*keys, "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = events.select("_row", "_at", "_kind", F.last("_version", True).over(so_far).alias("_version")).where("_kind = 1")
    held = F.col("_version")
    if at_most is not None:
        held = F.when(F.col("_at") - F.col("_version.at") < interval_seconds(at_most) * 1_000_000, held)
    met = met.select("_row", held.alias("_version")).unionByName(
        asked.where(~known).select("_row", nothing.alias("_version")))
    return met.select("_row.*", *[F.col("_version.of")[c].alias(c) for c in columns])
