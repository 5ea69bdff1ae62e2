"""Near-duplicate documents by ProbMinHash sketches, banding and exact verification.

Two different texts are linked if their shingles of five words have a similarity of 0.8 or more. The
similarity is the probability Jaccard of the shingles weighted by how often they occur, or the plain Jaccard of
the shingles if that is higher. A class is a connected component of links; equal texts share a class.

1. Rows are written once with a number. Every text gets a digest and a sketch of 252 registers, and a text with
   repeated shingles a second one with all weights 1 (for other texts the two are the same).
2. Equal texts become one node. The registers of a sketch, six at a time, are 42 of its buckets; a pair of either
   similarity of 0.8 shares none of them with a probability below 4 in a million.
3. Stars: in every bucket the other nodes are compared with its first one, by both sketches, then exactly on the whole
   texts. That is one comparison per member and never all pairs of a bucket.
4. Where a bucket of three or more still holds two components, its members are compared in blocks, other than
   those of its largest component among themselves. A block pair gives only links that join two components, so its
   output is no larger than its input.

All joins are by key with written inputs, which adaptive execution splits where a key is hot.

Edge cases: a text with fewer than five words has one shingle, all its words; null, empty and blank texts
take no part, each is a class of its own; equal rows share a class and one of them stays; an empty table gives an
empty result; clashing names of columns are avoided by numbering ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import probminhash, shingles
from tarnlake.llm.common import bounded_broadcast, fresh, map_arrow, slices
from tarnlake.llm.components import components
from tarnlake.session import stored

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
# Sketches this far below the threshold (eight standard deviations) cannot belong to a link.
LEAST_ESTIMATE = 0.6
# Members of a bucket that are compared in one go, and about how many bytes of text they may have together.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def linked(left: tuple, right: tuple) -> bool:
    """Whether two bags of shingles are near duplicates."""
    if probminhash.jaccard(left, right) >= THRESHOLD:
        return True
    repeated = len(left[0]) < left[1].sum() or len(right[0]) < right[1].sum()
    return repeated and probminhash.similarity(left, right) >= THRESHOLD


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, at = shingles.shingle_hashes(texts, WIDTH)
    return [probminhash.bag(hashes[at[k]:at[k + 1]]) for k in range(len(at) - 1)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "text")):
        hashes, at = shingles.shingle_hashes(batch.column("text"), WIDTH)
        table = probminhash.sketch(hashes, at, REGISTERS)
        rows = [row.tobytes() if at[k + 1] > at[k] else None for k, row in enumerate(table)]
        plain: list[bytes | None] = [None] * len(rows)
        if len(some := probminhash.repeated(hashes, at)):
            theirs = np.concatenate([hashes[at[k]:at[k + 1]] for k in some])
            ends = np.concatenate([[0], np.cumsum(np.diff(at)[some])])
            for k, row in zip(some, probminhash.sketch(theirs, ends, REGISTERS, plain=True)):
                plain[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("digest"), pa.array(rows, pa.binary()),
             pa.array(plain, pa.binary())], ["rid", "doc_id", "digest", "sketch", "plain"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches, by weight or plain, agree often enough."""
    for batch in batches:
        left, right, left_plain, right_plain = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for c in ("left", "right", "left_plain", "right_plain"))
        equal = np.maximum((left == right).sum(1), (left_plain == right_plain).sum(1))
        yield batch.select(["u", "v"]).filter(pa.array(equal >= LEAST_ESTIMATE * REGISTERS))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole texts are similar enough."""
    for batch in (s for b in batches for s in slices(b, "left")):
        left, right = _bags(batch.column("left")), _bags(batch.column("right"))
        yield batch.select(["u", "v"]).filter(pa.array([linked(a, b) for a, b in zip(left, right)], pa.bool_()))


def _block_links(table: pa.Table) -> pa.Table:
    """Links between members of a block pair that are in different components, as few as join them."""
    table = table.sort_by("node")
    nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
    texts = table["text"].combine_chunks()
    bags, n = _bags(texts), len(nodes)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[int, int] = {}
    for k, label in enumerate(labels):
        root[find(k)] = find(first.setdefault(label, k))
    # Sizes of all intersections, as products of incidence matrices over the shingles of two texts or more.
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    _, place, count = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True, return_counts=True)
    common = count[place] > 1
    rank = np.cumsum(count > 1) - 1
    rows, columns = owner[common], rank[place[common]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    shared = np.zeros((n, n), np.float64)
    step = 4096
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, step):
        a, b = np.searchsorted(columns, [start, start + step])
        part = np.zeros((n, step), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        shared += part @ part.T
    sizes = np.array([len(b[0]) for b in bags], np.float64)
    jaccard = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    found = []

    def join(i: int, j: int) -> None:
        if (a := find(i)) != (b := find(j)):
            root[a] = b
            found.append((nodes[i], nodes[j]))

    for i, j in zip(*np.nonzero(np.triu(jaccard >= THRESHOLD, 1))):
        join(int(i), int(j))
    # Weights matter only where shingles repeat; the sketches leave few pairs for the exact similarity.
    repeated = np.array([len(b[0]) < b[1].sum() for b in bags])
    if repeated.any() and len({find(k) for k in range(n)}) > 1:
        hashes, at = shingles.shingle_hashes(texts, WIDTH)
        table = probminhash.sketch(hashes, at, REGISTERS)
        for i in range(n - 1):
            close = (table[i + 1:] == table[i]).sum(1) >= LEAST_ESTIMATE * REGISTERS
            for j in np.flatnonzero(close & (repeated[i + 1:] | repeated[i])) + i + 1:
                if find(i) != find(int(j)) and probminhash.similarity(bags[i], bags[j]) >= THRESHOLD:
                    join(i, int(j))
    return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})


def _star_links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among (u, v), by sketch and then by text."""
    both = sketches.select("rid", "sketch", F.coalesce("plain", "sketch"))
    sketched = pairs.join(both.toDF("u", "left", "left_plain"), "u").join(both.toDF("v", "right", "right_plain"), "v")
    near = stored(map_arrow(sketched, _alike, "u long, v long"), "near-pairs")
    written = near.join(texts.select(F.col("rid").alias("u"), F.col("text").alias("left")), "u").join(
        texts.select(F.col("rid").alias("v"), F.col("text").alias("right")), "v")
    return map_arrow(written, _verified, "u long, v long")


def _block_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of buckets with two components or more, once per pair of blocks that they belong to.

    A bucket has as many blocks as its number of members or, if these are more, its bytes of text ask for. The members of a bucket's largest component need no comparison among themselves. They are in blocks of their own
    (``i`` from 0), each of which meets every block of the others (``j``); two blocks of the others have a negative ``i``.
    So a bucket of copies with a few others costs in proportion to its members.
    """
    labelled = stored(
        members.where("n > 2").join(labels, "node", "left").join(texts.select(F.col("rid").alias("node"), "bytes"), "node")
        .select("key", "node", F.coalesce("label", "node").alias("label"), "bytes"), "labelled-members")
    # Counted by component first, with a combine before the shuffle; the keys' number and largest come from these rows.
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    open_keys = stored(
        sizes.groupBy("key").agg(
            F.count("*").alias("parts"), F.max(F.struct("size", "label", "bytes")).alias("largest"),
            F.sum("size").alias("n"), F.sum("bytes").alias("of_all"))
        .where("parts > 1").select("key", "largest", "n", "of_all"), "open-buckets")

    def blocks(number: Column, size: Column) -> Column:
        return F.ceil(F.greatest(number / BLOCK, size / BLOCK_BYTES))

    largest = F.col("largest")
    inner = blocks(largest["size"], largest["bytes"])
    outer = blocks(F.col("n") - largest["size"], F.col("of_all") - largest["bytes"])
    inside = F.col("label") == F.col("largest")["label"]
    mine = F.pmod(F.xxhash64("node"), F.when(inside, inner).otherwise(outer))

    def pair(i, j):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))

    inner_blocks, outer_blocks = (F.sequence(F.lit(0).cast("long"), x - 1) for x in (inner, outer))
    others = F.filter(outer_blocks, lambda x: x != F.col("mine"))
    at = F.when(inside, F.transform(outer_blocks, lambda x: pair(F.col("mine"), x))).otherwise(F.concat(
        F.transform(inner_blocks, lambda x: pair(x, F.col("mine"))),
        F.transform(others, lambda x: pair(-F.least(x, F.col("mine")) - 1, F.greatest(x, F.col("mine"))))))
    return (labelled.join(open_keys, "key").withColumn("mine", mine)
            .select("key", "node", "label", F.explode(at).alias("at")).select("key", "node", "label", "at.i", "at.j"))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The numbered rows of ``docs`` (``rid``, written once), and rid, doc_id, class_id and whether the row stays.

    ``class_id`` is the least id of the class; the row that stays is the first of its class.
    """
    rid = fresh(docs.columns, "rid")
    base = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    plain = base.select(F.col(rid).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(
        map_arrow(plain.withColumn("digest", F.unhex(F.md5("text"))), _sketches, "rid long, doc_id long, digest binary, sketch binary, plain binary"), "sketches")
    shared = rows.where("sketch IS NOT NULL")
    nodes = stored(
        shared.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")), "distinct-texts")
    sketches = stored(
        shared.join(nodes, F.col("rid") == F.col("node"), "left_semi").select("rid", "sketch", "plain"), "distinct-sketches")

    def bands(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.xxhash64(
            band, F.substring(F.col(name), band * 2 * ROWS + 1, F.lit(2 * ROWS))))

    # Both sketches share the buckets, as the one sketch of a text without repeated shingles meets either.
    keys = F.when(F.col("plain").isNull(), bands("sketch")).otherwise(F.array_union(bands("sketch"), bands("plain")))
    buckets = sketches.select(F.col("rid").alias("node"), F.explode(keys).alias("key"))
    full = stored(
        buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    members = stored(buckets.join(full, "key"), "members")
    candidates = stored(members.select("node").distinct(), "candidates")
    texts = stored(
        plain.join(bounded_broadcast(candidates, 8), F.col("rid") == F.col("node"), "left_semi")
        .select("rid", "text", F.octet_length("text").alias("bytes")), "candidate-texts")

    stars = members.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    links = stored(_star_links(stars, sketches, texts), "star-links")
    labels = stored(components(links), "star-labels")
    more = (
        _block_pairs(members, labels, texts).join(texts.select(F.col("rid").alias("node"), "text"), "node")
        .select("key", "i", "j", "node", "label", "text")
        .groupBy("key", "i", "j").applyInArrow(_block_links, "u long, v long"))
    more = stored(more, "block-links")
    if more.take(1):
        labels = stored(components(links.unionAll(more)), "labels")
    by_node = nodes.join(labels, "node", "left").select(
        "digest", "node", "least", F.coalesce("label", "node").alias("label"))
    least = by_node.groupBy("label").agg(F.min("least").alias("class_id"))
    named = stored(by_node.join(least, "label").select("digest", "label", "class_id"), "classes")
    classes = rows.where("sketch IS NOT NULL").join(named, "digest").select(
        "rid", "doc_id", "class_id", (F.col("rid") == F.col("label")).alias("stays"))
    alone = rows.where("sketch IS NULL").select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("stays"))
    return base, classes.unionAll(alone)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class, with the columns of ``docs``."""
    rid = fresh(docs.columns, "rid")
    base, classes = classify(docs, doc_id, text)
    gone = stored(classes.where("NOT stays").select(F.col("rid").alias(rid)), "dropped")
    return base.join(bounded_broadcast(gone, 8), rid, "left_anti").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document its class."""
    return classify(docs.select("doc_id", "text"))[1].select("doc_id", "class_id", "stays")
