"""Connected components of a table of links, by alternating large-star and small-star steps.

(Kiveris and others, "Connected Components in MapReduce and Beyond", 2014.) Every step is a grouping with
map-side minima and a join; links are never brought together in one place, and each round's links are written
to the shared folder, so a lost executor does not repeat earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import stored


def _least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``m``, the least of u and all its v."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def _round(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = _least(large)
    small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of the links (long columns u and v)."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links, before = stored(ordered, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        links, before = stored(_round(links), "links"), now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionAll(stars.select("label", "label").distinct().toDF("node", "label"))
