"""Ranked lexical search over a K2-treap: a compressed quadtree on the grid of terms and documents.

A block of documents is a grid with a row per term (frequent ones first) and a column per document. The grid is cut
into four, level by level, and only quadrants with an entry are kept: a node is four bits that name its non-empty
quadrants, and the greatest impact in it, rounded up to a byte. Nodes lie in the order of their levels, so the place of a
child is a rank over these bits. An entry of the last level has its term frequency, from which its impact
is exact. The impact is the part of a score that the collection's size decides; a term's weight is multiplied in a search.

A search goes down the paths of an item's rows jointly: a range of documents carries one node per term, its bound is
the sum of weight times greatest impact, and halving the range moves every term to its child. The
ranges with the highest bounds are opened first, some at a time, until no bound reaches the score of the
k-th document found, so the result is exact. Blocks are searched where they lie; the few items travel to them, and
of every task only the k best per item are shuffled.

Edge cases: a null or empty text, or one without a term, is no document of the collection; each row is a document of its
own, so a repeated row may be listed twice; rows without an id count, and are last among equal scores; an item's terms are
those of all its rows, items without an id take no part; very long texts are a block of their own; an empty table
gives an empty result. Only the id and the text of either table are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import BROADCAST_BYTES, map_arrow, slices
from tarnlake.session import stored

BEST = 10
# A block is full at so many documents or terms with repeats.
BLOCK_DOCS, BLOCK_TERMS = 8192, 1_000_000
# Items that are sent to a block at a time, and ranges of documents that a search opens at a time.
GROUP_ITEMS, WIDTH = 1024, 128
# Fixed values of the score.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 90
# Impacts are below SCALE / 1000; a byte counts steps of this size.
_STEP = SCALE // 1000 // 255 + 1

# Bytes of a term stay, A-Z become a-z, all others part terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_ONES = np.array([bin(n).count("1") for n in range(16)], np.uint8)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + SATURATION * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number, with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """The quadtree of a block, ready for searches."""

    def __init__(self, ids: list[int | None], m: np.ndarray, names: list[bytes], levels: int,
                 nodes: bytes, greatest: bytes, frequencies: np.ndarray):
        self.ids, self.m, self.levels = ids, m, levels
        self.rows = {name: row for row, name in enumerate(names)}
        packed = np.frombuffer(nodes, np.uint8)
        self.nodes = np.stack([packed & 15, packed >> 4], 1).ravel()[:len(greatest)]
        self.greatest = np.frombuffer(greatest, np.uint8)
        # The place of a node's first child, by the ones before it; leaves follow the last node.
        ones = _ONES[self.nodes]
        self.first = (np.cumsum(ones, dtype=np.int64) - ones + 1).astype(np.int32)
        self.frequencies = frequencies

    @staticmethod
    def pack(places: np.ndarray, frequencies: np.ndarray, m: np.ndarray, levels: int) -> tuple[bytes, bytes]:
        """Nodes and greatest impacts of all levels, of the entries at the sorted, interleaved ``places``."""
        best = (impact(frequencies, m[_every_second(places)]) // _STEP + 1).astype(np.uint8)
        nodes, greatest = [], []
        for _ in range(levels):
            above = places >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            nodes.append(np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (places & np.uint64(3)).astype(np.uint8)), starts))
            best = np.maximum.reduceat(best, starts)
            greatest.append(best)
            places = above[starts]
        every = np.concatenate(nodes[::-1])
        every = np.append(every, np.uint8(0)) if len(every) % 2 else every
        return (every[::2] | (every[1::2] << 4)).tobytes(), np.concatenate(greatest[::-1]).tobytes()

    def best(self, names: list[bytes], weights: np.ndarray, k: int, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """``held``, the best (-score, missing id, id) so far, together with the best of this block."""
        here = [(self.rows[name], weight) for name, weight in zip(names, weights, strict=True) if name in self.rows and weight > 0]
        if not here:
            return held
        rows, weights = np.array([row for row, _ in here]), np.array([weight for _, weight in here], np.int64)
        # Which half of the rows a term takes at each level.
        turns = (rows[None, :] >> np.arange(self.levels - 1, -1, -1)[:, None]) & 1
        last = self.levels - 1
        bounds, depths, columns = np.array([np.iinfo(np.int64).max]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        paths = np.zeros((1, len(rows)), np.int32)
        while True:
            least = -held[-1][0] if len(held) == k else 1
            open_ = np.flatnonzero(bounds >= least)
            if not len(open_):
                return held
            if len(open_) < len(bounds):
                bounds, depths, columns, paths = bounds[open_], depths[open_], columns[open_], paths[open_]
            now = np.zeros(len(bounds), bool)
            now[np.argpartition(bounds, -WIDTH)[-WIDTH:] if len(bounds) > WIDTH else slice(None)] = True
            depth, column, path = depths[now], columns[now], paths[now]
            there = path >= 0
            at = np.where(there, path, 0)
            bits, first, turn = self.nodes[at], self.first[at], turns[depth]
            grown = [(bounds[~now], depths[~now], columns[~now], paths[~now])]
            for half in (0, 1):
                quadrant = (2 * turn + half).astype(np.uint8)
                has = there & ((bits >> quadrant) & 1).astype(bool)
                child = np.where(has, first + _ONES[bits & ((1 << quadrant) - 1).astype(np.uint8)], -1).astype(np.int32)
                below = column * 2 + half
                leaf = depth == last
                if leaf.any():
                    entry, doc = child[leaf], below[leaf]
                    tf = np.where(entry >= 0, self.frequencies[np.where(entry >= 0, entry - len(self.nodes), 0)], 0).astype(np.int64)
                    in_grid = doc < len(self.m)
                    scores = (impact(tf, self.m[np.where(in_grid, doc, 0)][:, None]) * weights).sum(1)
                    for row in np.flatnonzero(in_grid & (scores >= least)).tolist():
                        name = self.ids[doc[row]]
                        held.append((-int(scores[row]), name is None, name or 0))
                inner = ~leaf
                if inner.any():
                    child = child[inner]
                    bound = (np.where(child >= 0, self.greatest[np.where(child >= 0, child, 0)], 0).astype(np.int64) * weights).sum(1) * _STEP
                    some = bound >= least
                    grown.append((bound[some], depth[inner][some] + 1, below[inner][some], child[some]))
            held = sorted(held)[:k]
            bounds, depths, columns, paths = (np.concatenate(parts) for parts in zip(*grown, strict=True))


def _every_second(bits: np.ndarray) -> np.ndarray:
    """The bits at even places, which hold the column; of places without their lowest bit, the row."""
    x = bits & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF),
                        (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


class _Terms(dict):
    """Numbers of terms, in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for content in part.column("text").to_pylist():
                    count = len(terms(content))
                    n += count > 0
                    total += count
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    found = map_arrow(docs.select(docs[text].alias("text")), run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def index(docs: DataFrame, of: tuple[int, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The blocks of all documents, a row each; ``of`` are the collection's ``sizes``."""
    n_docs, n_terms = of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, lengths, coded = _Terms(), [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            number = np.concatenate(coded)
            counts = np.bincount(number, minlength=len(known))
            # Frequent terms first: neighbours are alike, so that bounds of wide rows say more.
            order = np.argsort(-counts, kind="stable")
            row = np.empty(len(order), np.int64)
            row[order] = np.arange(len(order))
            names = list(known)
            names = [names[k] for k in order.tolist()]
            size = np.array(lengths, np.int64)
            # Python's integers cannot overflow here.
            m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in lengths], np.int64)
            levels = max(1, math.ceil(math.log2(max(len(names), len(ids)))))
            places, frequencies = np.unique(
                (_spread(row[number]) << np.uint64(1)) | _spread(np.repeat(np.arange(len(ids)), size)), return_counts=True)
            held_by = np.bincount(_every_second(places >> np.uint64(1)), minlength=len(names))
            nodes, greatest = Treap.pack(places, frequencies, m, levels)
            wide = "<u1" if frequencies.max() < 256 else "<u4"
            batch = pa.RecordBatch.from_pydict({
                "ids": pa.array([list(ids)], pa.list_(pa.int64())), "m": pa.array([m.astype("<i8").tobytes()], pa.binary()),
                "terms": pa.array([names], pa.list_(pa.binary())), "df": pa.array([held_by.astype(np.int64)], pa.list_(pa.int64())),
                "levels": pa.array([levels], pa.int32()), "nodes": pa.array([nodes], pa.binary()),
                "greatest": pa.array([greatest], pa.binary()),
                "frequencies": pa.array([frequencies.astype(wide).tobytes()], pa.binary()),
                "entry_bytes": pa.array([int(wide[-1])], pa.int32())})
            known.clear(), ids.clear(), lengths.clear(), coded.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, content in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = terms(content)
                    if not found:
                        continue
                    ids.append(doc)
                    lengths.append(len(found))
                    coded.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    held += len(found)
                    if len(ids) >= BLOCK_DOCS or held >= BLOCK_TERMS:
                        yield flush()
                        held = 0
        if ids:
            yield flush()

    rows = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].alias("text"))
    return map_arrow(rows, run, (
        "ids array<bigint>, m binary, terms array<binary>, df array<bigint>, levels int, nodes binary, greatest binary, "
        "frequencies binary, entry_bytes int"))


def item_terms(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item`` and ``term``, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for item, content in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = sorted(set(terms(content)))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], ["item", "term"])

    rows = items.select(items[item_id].cast("long").alias("item"), items[text].alias("text")).where("item IS NOT NULL")
    return map_arrow(rows, run, "item long, term binary").distinct()


def weighted(blocks: DataFrame, wanted: DataFrame, n_docs: int) -> DataFrame:
    """``item``, ``names`` and ``weights`` of the terms that any document has; ``blocks`` knows how many do."""
    held = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("of")).select(F.col("of.terms").alias("term"), F.col("of.df").alias("df"))
    df = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    each = wanted.join(df, "term").select("item", F.struct("term", weight.alias("weight")).alias("of"))
    # An item's own terms, as many as its text has.
    lists = each.groupBy("item").agg(F.sort_array(F.collect_list("of")).alias("of"))
    return lists.select("item", F.col("of.term").alias("names"), F.col("of.weight").alias("weights"))


def _groups(items: DataFrame) -> DataFrame:
    """Items in rows of about ``GROUP_ITEMS``; every lane of blocks gets all of them.

    A lane is a share of the blocks. Where the items fit into a broadcast, by their counted size, there is one lane;
    otherwise there are as many as shuffle partitions, and the groups are shuffled to them.
    """
    names = F.aggregate("names", F.lit(0), lambda total, x: total + F.octet_length(x) + 16)
    count, size = items.agg(F.count("*"), F.sum(names + 16)).first()
    number = -(-count // GROUP_ITEMS) or 1
    grouped = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(number)).alias("group")).agg(
        F.collect_list(F.struct("item", "names", "weights")).alias("items")).drop("group")
    if (size or 0) <= BROADCAST_BYTES:
        return F.broadcast(grouped.withColumn("lane", F.lit(0)))
    lanes = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))


def _lane(groups: DataFrame) -> Column:
    lanes = groups.agg(F.max("lane")).first()[0] or 0
    return F.pmod(F.xxhash64("m", "nodes"), F.lit(lanes + 1)).cast("int")


def search(blocks: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item (see ``weighted``)."""
    groups = _groups(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                frequencies = np.frombuffer(block["frequencies"], f"<u{block['entry_bytes']}")
                treap = Treap(block["ids"], np.frombuffer(block["m"], "<i8"), block["terms"], block["levels"],
                              block["nodes"], block["greatest"], frequencies)
                for item in block["items"]:
                    best[item["item"]] = treap.best(item["names"], item["weights"], k, best.get(item["item"], []))
        found = [(item, None if missing else doc, -score) for item, held in best.items() for score, missing, doc in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    met = blocks.withColumn("lane", _lane(groups)).join(groups, "lane").drop("lane", "df")
    found = map_arrow(met, run, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    of = sizes(docs)
    blocks = stored(index(docs, of), "lexical-index")
    return search(blocks, stored(weighted(blocks, item_terms(items), of[0]), "lexical-items"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL
), d AS (
  SELECT rid, sum(tf)::BIGINT AS n FROM p GROUP BY rid
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d
), m AS (
  SELECT rid, 10 + (90 * n * docs) // total AS m FROM d, c
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c
  WHERE term IN (SELECT term FROM i) GROUP BY term, docs
), s AS (
  SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
