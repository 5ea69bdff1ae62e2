"""Queries over metric samples ``(metric, labels MAP<STRING,STRING>, ts, value DOUBLE)``.

A series is a metric with one set of labels. A single series may hold a third of all samples, so no
operator here sends a whole series to one task: they either combine on the map side or work on
slices of a series in time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import interval_seconds, moment, since, threshold_class
from tarnlake.functions.moments import AsOf


def series_key(labels: str = "labels") -> Column:
    """Labels as a sorted array of pairs: equal for equal label sets, and groupable."""
    return F.sort_array(F.map_entries(labels))


def _labels_of(series: str) -> Column:
    return F.map_from_entries(series)


def _micros(time_column: str) -> Column:
    return F.unix_micros(F.col(time_column).cast("timestamp"))


def rate(samples: DataFrame, metric: str, range_: str = "5 minutes", slice_: str = "1 hour") -> DataFrame:
    """Per-second increase of a counter over the trailing range, at every sample.

    The increase is the sum of the differences between neighbouring samples inside the closed range
    ``[ts - range, ts]``; where a value drops the counter was restarted and the new value itself is
    the increase. It is divided by the seconds between the first and the last sample of the range
    and not extrapolated to the edges. With fewer than two samples there is no row, nor for samples
    at one instant. Samples of a series must have different times.

    The result at a sample depends on the trailing range only. A series is therefore cut into
    slices, each slice also gets the samples of one range before it, and windows run per slice: the
    work of the largest series is spread over as many tasks as it has slices.
    """
    width = interval_seconds(range_) * 1_000_000
    span = max(interval_seconds(slice_) * 1_000_000, width)
    time_type = samples.schema["ts"].dataType
    base = samples.where(
        (F.col("metric") == metric) & F.col("value").isNotNull() & F.col("ts").isNotNull()
    ).select(series_key().alias("series"), "value", _micros("ts").alias("at"))
    own, last = F.expr(f"at DIV {span}"), F.expr(f"(at + {width}) DIV {span}")
    sliced = base.select("*", F.explode(F.sequence(own, last)).alias("slice"))

    in_slice = Window.partitionBy("series", "slice").orderBy("at")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_range = in_slice.rangeBetween(-width, Window.currentRow)
    # A total that never restarts: its difference over a range is the sum of the steps inside it.
    total = (
        sliced.withColumn("previous", F.lag("value").over(in_slice))
        .withColumn(
            "step",
            F.when(F.col("previous").isNull(), F.lit(0.0))
            .when(F.col("value") < F.col("previous"), F.col("value"))
            .otherwise(F.col("value") - F.col("previous")),
        )
        .withColumn("total", F.sum("step").over(so_far))
    )
    measured = total.select(
        "series", "slice", "at", "total",
        F.first("at").over(in_range).alias("first_at"),
        F.first("total").over(in_range).alias("first_total"),
    ).where((own == F.col("slice")) & (F.col("at") > F.col("first_at")))
    covered = (F.col("at") - F.col("first_at")) / F.lit(1_000_000.0)
    return measured.select(
        F.lit(metric).alias("metric"),
        _labels_of("series").alias("labels"),
        F.timestamp_micros("at").cast(time_type).alias("ts"),
        ((F.col("total") - F.col("first_total")) / covered).alias("value"),
    )


def percent_of(samples: DataFrame, part: str, whole: str) -> DataFrame:
    """``part / whole * 100`` of two gauges with the same labels and time; NULL if the whole is 0.

    One pass and one aggregate in place of a self-join: (series, time) is unique per metric, so the
    maximum is just the value.
    """
    pairs = (
        samples.where(F.col("metric").isin(part, whole))
        .groupBy(series_key().alias("series"), "ts")
        .agg(
            F.max(F.when(F.col("metric") == part, F.col("value"))).alias("part"),
            F.max(F.when(F.col("metric") == whole, F.col("value"))).alias("whole"),
        )
        .where(F.col("part").isNotNull() & F.col("whole").isNotNull())
    )
    return pairs.select(
        _labels_of("series").alias("labels"),
        "ts",
        (F.col("part") / F.nullif("whole", F.lit(0.0)) * 100).alias("value"),
    )


def with_threshold(samples: DataFrame) -> DataFrame:
    """The colour class of every percentage."""
    return samples.withColumn("level", threshold_class(F.col("value")))


def _until(samples: DataFrame, as_of: AsOf) -> Column:
    """Nothing after ``as_of``; without one, nothing is left out."""
    if as_of is None:
        return F.lit(True)
    return F.col("ts") <= moment(as_of, samples.schema["ts"].dataType)


def latest_samples(
    samples: DataFrame, metric: str, as_of: AsOf = None, look_back: str | None = None
) -> DataFrame:
    """The last value of every series of a metric, at ``as_of`` or now.

    All history counts unless a ``look_back`` is given; then a series without a sample in it is not
    listed, and only the files of that time are read.
    """
    recent = F.lit(True) if look_back is None else since(samples, "ts", as_of, look_back)
    return (
        samples.where((F.col("metric") == metric) & _until(samples, as_of) & recent)
        .groupBy(series_key().alias("series"))
        .agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
        .select(F.lit(metric).alias("metric"), _labels_of("series").alias("labels"), "ts", "value")
    )


def range_select(samples: DataFrame, metric: str, as_of: AsOf = None, look_back: str = "1 hour") -> DataFrame:
    """The samples of a metric in the look-back up to ``as_of`` or now."""
    recent = since(samples, "ts", as_of, look_back) & _until(samples, as_of)
    return samples.where((F.col("metric") == metric) & recent)


def legend(template: str, labels: str = "labels") -> Column:
    """A legend such as ``Records In - {{job_name}}``; a missing label is empty text."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    parts = [
        F.coalesce(F.col(labels)[piece], F.lit("")) if position % 2 else F.lit(piece)
        for position, piece in enumerate(pieces)
    ]
    return F.concat(*parts)


def on_grid(samples: DataFrame, metric: str, step: str = "15 seconds") -> DataFrame:
    """The last value of every series in every step of a regular grid."""
    return (
        samples.where(F.col("metric") == metric)
        .groupBy(series_key().alias("series"), F.window("ts", step))
        .agg(F.max_by("value", "ts").alias("value"))
        .select(
            F.lit(metric).alias("metric"),
            _labels_of("series").alias("labels"),
            F.col("window.start").alias("ts"),
            "value",
        )
    )


def at_steps(
    samples: DataFrame, metric: str, start: AsOf, end: AsOf, step: str = "15 seconds", look_back: str = "5 minutes",
    slice_: str = "1 hour", gaps: bool = False,
) -> DataFrame:
    """The value of every series at every step from ``start`` to ``end``: its last sample that is at most ``look_back`` old.

    A step without such a sample has no row, or with ``gaps`` a row without a value. Of samples of a series at one
    time the greatest value counts.

    A sample holds until the next one or until it is too old. So it is looked at within its slice of time only; a
    slice also gets the samples of one look-back behind it, in which the next one may lie. The largest
    series is as many groups as it has slices, and each sample yields its own steps without a join.
    """
    width, every = interval_seconds(look_back) * 1_000_000, interval_seconds(step) * 1_000_000
    span = max(interval_seconds(slice_) * 1_000_000, width)
    time_type = samples.schema["ts"].dataType
    first, last = moment(start, time_type), moment(end, time_type)
    zero, final = F.unix_micros(first.cast("timestamp")), F.unix_micros(last.cast("timestamp"))
    base = samples.where(
        (F.col("metric") == metric) & F.col("value").isNotNull()
        & (F.col("ts") >= first - F.expr(f"INTERVAL {look_back}")) & (F.col("ts") <= last)
    ).select(series_key().alias("series"), "value", _micros("ts").alias("at"))
    own, other = F.expr(f"at DIV {span}"), F.expr(f"(at - {width}) DIV {span}")
    sliced = base.select("*", F.explode(F.array_distinct(F.array(other, own))).alias("slice"))
    in_slice = Window.partitionBy("series", "slice").orderBy("at", "value")
    held = sliced.withColumn("next", F.lead("at").over(in_slice)).where(F.col("slice") == own)
    until = F.least(F.coalesce("next", F.col("at") + width + 1), F.col("at") + width + 1, final + 1)
    numbered = held.select("series", "value", (F.col("at") - zero).alias("from"), (until - zero).alias("until"))
    begin = F.when(F.col("from") <= 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"(from + {every - 1}) DIV {every}"))
    stop = F.when(F.col("until") <= 0, F.lit(-1).cast("bigint")).otherwise(F.expr(f"(until - 1) DIV {every}"))
    found = numbered.withColumns({"begin": begin, "stop": stop}).where("begin <= stop").select(
        "series", "value", F.explode(F.sequence("begin", "stop")).alias("number"))
    if gaps:
        numbers = F.sequence(F.lit(0).cast("bigint"), ((final - zero) / every).cast("bigint"))
        grid = base.select("series").distinct().select("series", F.explode(numbers).alias("number"))
        found = grid.join(found, ["series", "number"], "left")
    return found.select(
        F.lit(metric).alias("metric"), _labels_of("series").alias("labels"),
        F.timestamp_micros(zero + F.col("number") * every).cast(time_type).alias("ts"), "value")
