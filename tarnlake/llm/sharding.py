"""Shards that are balanced in bytes, tokens and rows at once, by vector bin packing.

Equal texts form a group, and a group is placed as a whole. Its vector is its share of all bytes, tokens and rows.
Items are placed from the largest to the smallest, each in the shard where the dot product of its vector
with the shard's residual capacity is highest.

Items are few whatever the input: at most ``3 * LARGE`` groups can hold more than a ``LARGE``-th of some
dimension, and each of these is an item. All other groups are dealt by a hash of their text into ``COARSE`` bundles and,
a small part of them, into ``FINE`` much smaller ones that even out the rest. A group that alone has more bytes than a
shard is split by row into equal parts, as no packing of whole groups would be even in what the law is about; every other group
stays whole, whatever its number of rows. Everything about rows is joined by key with the items' shards, a
table of bounded size.

The law is ``bytes``: sizes near equal. Places within a shard come from two passes: counts per shard and
partition, then a numbering inside each of them.

Edge cases: a null text has size 1 and no tokens, an empty one too, and both are one group; equal rows stay
together; an empty table gives no rows; clashing names of columns are avoided by numbering ours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import bounded_broadcast, fresh
from tarnlake.session import stored

SHARDS = 16
LARGE, COARSE, FINE = 2048, 2048, 1024
# Every so many-th of the small groups goes to the fine bundles.
FINE_EVERY = 32
# Parts of a split group, per shard that it would fill.
PARTS = 8
DIMENSIONS = ("bytes", "tokens", "rows")
# The law is on bytes, so their share of the dot product is the largest.
WEIGHTS = (8.0, 1.0, 1.0)


def place(vectors: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each item; ``vectors`` holds its share of each dimension's total."""
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    # Ties are broken by the item's number and the shard's, so the outcome is the same in every run.
    for item in np.argsort(-vectors.max(1, initial=0), kind="stable"):
        out[item] = np.argmax(residual @ (WEIGHTS * vectors[item]))
        residual[out[item]] -= vectors[item]
    return out


def _bundle(key: str) -> Column:
    """The bundle of a small group, from the digest of its text."""
    mixed = F.xxhash64(key)
    again = F.xxhash64(mixed, F.lit(1))
    return F.when(F.pmod(mixed, F.lit(FINE_EVERY)) == 0, F.pmod(again, F.lit(FINE)) + COARSE).otherwise(
        F.pmod(again, F.lit(COARSE))).cast("int")


def assign(docs: DataFrame, text: str = "text", payload: list[str] | None = None, shards: int = SHARDS) -> DataFrame:
    """``docs`` with a struct column ``placed``: size, text_crc32, shard and slot.

    ``payload`` names the columns to carry (default: all).
    """
    names = docs.columns if payload is None else payload
    out = fresh(names, "placed")
    body = F.coalesce(docs[text], F.lit(""))
    # The given columns travel in one struct, so that no name of theirs can clash with ours.
    rows = stored(docs.select(F.struct(*[docs[name] for name in names]).alias("row"), F.struct(
        (F.octet_length(body) + 1).cast("long").alias("bytes"),
        F.size(F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("tokens"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
        F.unhex(F.md5(body)).alias("key"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"),
    ).alias("fact")), "shard-rows")
    fact = F.col("fact")
    groups = stored(
        rows.groupBy(fact["key"].alias("key")).agg(
            F.sum(fact["bytes"]).alias("bytes"), F.sum(fact["tokens"]).alias("tokens"), F.count("*").alias("rows")),
        "shard-groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    weight = F.greatest(*[F.col(d) / F.lit(float(max(total[d], 1))) for d in DIMENSIONS])
    sized = groups.withColumn("weight", weight)
    heavy = F.col("bytes") / F.lit(float(max(total["bytes"], 1))) > 1 / shards
    big = sized.where(F.col("weight") > 1 / LARGE).withColumn(
        "parts", F.when(heavy, F.ceil(F.col("weight") * shards * PARTS)).otherwise(F.lit(1)))
    small = sized.where(F.col("weight") <= 1 / LARGE)
    bundles = small.withColumn("bundle", _bundle("key"))
    # Bounded by 3 * LARGE and by COARSE + FINE rows.
    big_rows = big.orderBy("key").collect()
    bundle_rows = bundles.groupBy("bundle").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).orderBy("bundle").collect()

    items = [(bytes(r["key"]), part, [r[d] / r["parts"] for d in DIMENSIONS]) for r in big_rows for part in range(r["parts"])]
    vectors = np.array([v for _, _, v in items] + [[r[d] for d in DIMENSIONS] for r in bundle_rows], float)
    shard = place(vectors.reshape(-1, 3) / np.maximum([total[d] for d in DIMENSIONS], 1), shards).tolist()
    session = docs.sparkSession
    of_big: dict[bytes, list[int]] = {}
    for (key, _, _), chosen in zip(items, shard):
        of_big.setdefault(key, []).append(chosen)
    keyed = session.createDataFrame([(bytearray(k), v) for k, v in of_big.items()], "key binary, into array<int>")
    dealt = [0] * (COARSE + FINE)
    for r, chosen in zip(bundle_rows, shard[len(items):]):
        dealt[r["bundle"]] = chosen

    rows = rows.select("*", fact["key"].alias("key_of_row")).join(F.broadcast(keyed), F.col("key_of_row") == F.col("key"), "left")
    shard_of_bundle = session.createDataFrame(list(enumerate(dealt)), "bundle int, dealt int")
    rows = rows.withColumn("bundle", _bundle("key_of_row")).join(F.broadcast(shard_of_bundle), "bundle")
    split = F.get(F.col("into"), F.pmod(F.xxhash64(fact["seq"]), F.greatest(F.size("into"), F.lit(1))).cast("int"))
    rows = rows.select("row", "fact", F.coalesce(split, "dealt").alias("shard"))
    counts = stored(rows.groupBy("shard", fact["part"].alias("part")).agg(F.count("*").alias("n")), "shard-counts")
    earlier = counts.select("shard", "part", (
        F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("earlier"))
    inner = F.row_number().over(Window.partitionBy("shard", fact["part"]).orderBy(fact["seq"])) - 1
    rows = rows.withColumn("inner", inner).withColumn("part", fact["part"])
    return rows.join(bounded_broadcast(earlier, 24), ["shard", "part"]).select(
        *[F.col("row")[n].alias(n) for n in names],
        F.struct(fact["bytes"].alias("size"), fact["crc"].alias("text_crc32"), F.col("shard").cast("int").alias("shard"),
                 (F.col("earlier") + F.col("inner")).cast("long").alias("slot")).alias(out))


def write(docs: DataFrame, path: str, **options) -> None:
    """Write ``docs`` into one folder per shard, each partition's rows of a shard in a file of their own."""
    placed = assign(docs, **options)
    out = placed.columns[-1]
    shard = fresh(docs.columns, "shard")
    placed.select(*docs.columns, F.col(out)["shard"].alias(shard)).write.partitionBy(shard).parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """Per document its size, checksum, shard and place."""
    placed = assign(docs, payload=["doc_id"])
    return placed.select(
        "doc_id", F.col("placed")["size"].alias("size"), F.col("placed")["text_crc32"].alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("placed")["shard"].alias("shard"), F.col("placed")["slot"].alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
