"""Distinct counts that add up: stored bitmaps of whole-number ids, exact and mergeable.

COUNT(DISTINCT) per hour cannot be summed up to days. A bitmap per hour can: the bitmaps of a day are or-ed, so reports
of any longer time come from small stored rows and never from the events again. Or-ing the same bitmap twice changes
nothing, so a batch that is written again does no harm.

Ids are cut into buckets of 32,768; each row is one bucket's bitmap. Bitmaps are built on the map side, so a hot group costs a
few rows per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITMAP = "id_bucket", "id_bitmap"


def id_bitmaps(rows: DataFrame, groups: Mapping[str, Column], value: str) -> DataFrame:
    """A row per group and bucket of ids, with its bitmap and its number of rows (``row_count``).

    A NULL id counts as a row and is no distinct value; it has a row of its own, without a bucket.
    """
    bucket = F.bitmap_bucket_number(value).alias(BUCKET)
    return rows.groupBy(*[column.alias(name) for name, column in groups.items()], bucket).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias(BITMAP), F.count("*").alias("row_count"))


def merged(bitmaps: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """The same for wider groups, or for bitmaps of several batches."""
    return bitmaps.groupBy(*[column.alias(name) for name, column in groups.items()], BUCKET).agg(
        F.bitmap_or_agg(BITMAP).alias(BITMAP), F.sum("row_count").alias("row_count"))


def distinct_counts(bitmaps: DataFrame, groups: Sequence[str], distinct_name: str, count_name: str) -> DataFrame:
    """Distinct ids and rows per group, of bitmaps that are merged: one row per group and bucket."""
    ids = F.when(F.col(BUCKET).isNotNull(), F.bitmap_count(BITMAP)).otherwise(0)
    return bitmaps.groupBy(*groups).agg(F.sum(ids).alias(distinct_name), F.sum("row_count").alias(count_name))
