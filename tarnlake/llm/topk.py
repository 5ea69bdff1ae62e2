"""Exact top-k by inner product over a bit-sliced index.

Every component is a whole number, floor(64 x). A block of rows is stored by bits: for each dimension and each
bit of its values (counted from the block's smallest) a bitmap with one bit per row. The scores of a group
of queries for a block are added up as bitmaps: for each dimension, the slices of its product with a query's component are
looked up among those made ready for the block, and summed by carry-save adders, so a score is itself a set of
slices. (For components of a wide range the products are not made ready but summed by the query's bits.) The best rows are then selected from the most significant slice
downward; the rows that are equal down to the last slice at the boundary are resolved by their ids.

Every block gives each query its best k, and the best k of these are the result. Blocks of rows and groups of
queries meet on a grid of keys: each block goes to every column of its row, each group to every row of its
column, so no task sees all of either.

Rows with a component of 2**25 or more are in blocks of their own, with 64-bit values. Where scores may reach 2**62,
a block's are computed without slices: in 64 bits the ones that surely fit, the others in Python integers.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows without an id, take
no part; vectors of another length than a query's are no candidates; rows with the query's id count as its own, and of
several the one with the least vector is the query; equal vectors are ranked by id; an empty table gives no rows. Only the id and the vector are read. A component or a
score that does not fit 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import map_arrow

SCALE = 64
QUERY_EVERY = 20
BEST = 20
BLOCK_ROWS, GROUP_ROWS = 8192, 256
# Queries that are added up together; their bitmaps then stay in the processor's cache.
_TOGETHER = 32
# Products are kept ready for ranges of query components, widened to multiples of _ROUND, up to so many factors times bits.
_ROUND, _MOST_PRODUCTS = 16, 1024
# Components from here on are stored in 64 bits.
_LARGEST = 1 << 25
# Scores of the bit-sliced index stay below this.
_SAFE = 1 << 62

Slices = list[np.ndarray]


def add(a: Slices, b: Slices, width: int) -> Slices:
    """The sum of two sets of slices, least significant first, modulo 2**width."""
    out: Slices = []
    carry = None
    for k in range(min(width, max(len(a), len(b)) + 1)):
        x = a[k] if k < len(a) else None
        y = b[k] if k < len(b) else None
        if x is None or y is None:
            one = y if x is None else x
            if one is None:
                if carry is not None:
                    out.append(carry)
                break
            if carry is None:
                out.append(one)
            else:
                out.append(one ^ carry)
                carry = one & carry
        elif carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return out


def total(terms: list[Slices], width: int) -> Slices:
    """The sum of many sets of slices, added in pairs."""
    while len(terms) > 1:
        terms = [add(terms[k], terms[k + 1], width) if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
    return terms[0] if terms else []


def select(slices: Slices, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query, the bitmap of rows surely among the best ``k``, and of those equal at the boundary.

    ``slices`` are unsigned, most significant last; ``alive`` marks the rows that may be chosen.
    """
    sure, equal = np.zeros_like(alive), alive
    for one in reversed(slices):
        above = equal & one
        counts = np.bitwise_count(sure | above).sum(1, dtype=np.int64)
        more, fewer = counts > k, counts < k
        new_sure = np.where(more[:, None], sure, sure | above)
        equal = np.where(more[:, None], above, np.where(fewer[:, None], equal & ~one, np.uint64(0)))
        sure = new_sure
    return sure, equal


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view("<u8")


class Block:
    """The slices of a block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low = self.values.min(0)
        self.largest = max(int(self.values.max()), -int(self.values.min()))
        self.bits = max(high - low for low, high in zip(self.low.tolist(), self.values.max(0).tolist())).bit_length()
        self.slices = []
        if 2 * self.largest < _SAFE:
            self.slices = [[bitmap(((column >> b) & 1).astype(bool)) for b in range(int(column.max()).bit_length())]
                           for column in (self.values - self.low).T]
        self.valid = bitmap(np.ones(len(ids), bool))
        self._multiples: tuple[tuple[int, int], tuple[np.ndarray, Slices]] | None = None  # range, products

    def _products(self, low: int, high: int) -> tuple[int, np.ndarray, Slices]:
        """The least component that they hold for, the slices of every dimension times 0 up to the range's width, and those
        of the sum of all dimensions times the least component's distance from 0.

        They are made once per block, and anew only for a query with a component beyond their range.
        """
        if self._multiples is None or not self._multiples[0][0] <= low <= high <= self._multiples[0][1]:
            if self._multiples is not None:
                low, high = min(low, self._multiples[0][0]), max(high, self._multiples[0][1])
            words, factors = len(self.valid), high - low
            width = (factors * ((1 << self.bits) - 1)).bit_length()
            one = np.zeros((self.bits, len(self.slices), words), np.uint64)
            for d, slices in enumerate(self.slices):
                for b, bits in enumerate(slices):
                    one[b, d] = bits
            table = np.zeros((len(self.slices), width, factors + 1, words), np.uint64)
            at: Slices = []
            for factor in range(1, factors + 1):
                at = add(at, list(one), width) if at else list(one)
                for b, bits in enumerate(at):
                    table[:, b, factor] = bits
            summed = total([[bits[None] for bits in slices] for slices in self.slices if slices], 64)
            offset: Slices = []
            for b in range((-low).bit_length()):
                if -low >> b & 1:
                    shifted = [np.zeros((1, words), np.uint64)] * b + summed
                    offset = add(offset, shifted, 64) if offset else shifted
            self._multiples = (low, high), (table, offset)
        return self._multiples[0][0], *self._multiples[1]

    def _summed(self, queries: np.ndarray, low: int, high: int, width: int) -> Slices:
        """The slices of the scores, by one addition per dimension of a ready product.

        Components are counted from ``low``, so that no product is negative; what that adds to a row is taken off at the end.
        """
        low, table, offset = self._products(low, high)
        zero = np.zeros((len(queries), len(self.valid)), np.uint64)
        held: list[tuple[int, Slices]] = []
        for d in range(queries.shape[1]):
            picked = np.take(table[d], queries[:, d] - low, axis=1)
            rank, one = 0, [picked[b] for b in range(len(picked))]
            # Sums of equally many dimensions are added, so that few are held at a time.
            while held and held[-1][0] == rank:
                one, rank = add(held.pop()[1], one, width), rank + 1
            held.append((rank, one))
        score = total([one for _, one in reversed(held)], width)
        score = score + [zero] * (width - len(score))
        if offset:
            minus = (offset + [zero[:1]] * width)[:width]
            score = add(add(score, [~m for m in minus], width), [np.broadcast_to(~np.uint64(0), zero.shape)], width)
        return score

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, row, score) of the best ``k`` rows of this block for each query."""
        largest = int(np.abs(queries).max(initial=0))
        most = largest * max((1 << self.bits) - 1, 1) * queries.shape[1]
        if not self.slices or max(most, largest * self.largest * queries.shape[1]) >= _SAFE:
            return self._computed(ids, queries, k)
        base = queries @ self.low
        width = most.bit_length() + 2
        low = min(0, int(queries.min(initial=0)) // _ROUND * _ROUND)
        high = (int(queries.max(initial=0)) // _ROUND + 1) * _ROUND
        if self.bits and (high - low) * self.bits <= _MOST_PRODUCTS:
            score = self._summed(queries, low, high, width)
        else:
            score = self._summed_by_bits(queries, width, largest)
        return self._chosen(score, ids, base, k)

    def _summed_by_bits(self, queries: np.ndarray, width: int, largest: int) -> Slices:
        """The slices of the scores of queries with components of a wide range, bit by bit of the components."""
        # Two's complement: the highest bit of a query's component counts negatively.
        top = largest.bit_length()
        plus: list[Slices] = []
        minus: Slices = []
        for b in range(top + 1):
            bit = ((queries >> b) & 1).astype(bool)
            masks = np.where(bit, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            terms = [[masks[:, d, None] & s for s in self.slices[d]] for d in range(queries.shape[1]) if self.slices[d] and bit[:, d].any()]
            summed = total(terms, width)
            zero = np.zeros((len(queries), len(self.valid)), np.uint64)
            if summed:
                shifted = [zero] * b + summed
                if b == top:
                    minus = shifted
                else:
                    plus.append(shifted)
        zero = np.zeros((len(queries), len(self.valid)), np.uint64)
        score = total(plus, width)
        score = score + [zero] * (width - len(score))
        if minus:
            # a - b = a + ~b + 1, modulo 2**width
            minus = (minus + [zero] * width)[:width]
            ones = np.broadcast_to(~np.uint64(0), zero.shape)
            score = add(add(score, [~m for m in minus], width), [ones], width)
        return score

    def _chosen(self, score: Slices, ids: np.ndarray, base: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, row, score) of the best ``k`` rows, from the slices of the scores."""
        zero = np.zeros((len(ids), len(self.valid)), np.uint64)
        score = [*score[:-1], ~score[-1]]
        alive = np.broadcast_to(self.valid, zero.shape).copy()
        for q, name in enumerate(ids):
            for row in range(*np.searchsorted(self.ids, [name, name + 1])):
                alive[q, row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure, equal = select(score, alive, k)
        out = []
        for q, name in enumerate(ids.tolist()):
            chosen = _rows(sure[q])
            # Rows are in the order of their ids, so the first of the equal ones have the smallest.
            chosen = np.concatenate([chosen, _rows(equal[q])[:k - len(chosen)]])
            values = self._read(score, q, chosen) + base[q]
            out += [(name, row, value) for row, value in zip(self.ids[chosen].tolist(), values.tolist())]
        return out

    def _computed(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """As ``best``, without the index, for scores that may be large."""
        out = []
        size = np.abs(self.values).astype(np.float64)
        for name, query in zip(ids.tolist(), queries):
            score = self.values @ query
            others = self.ids != name
            # Sums of magnitudes below the bound fit 64 bits in every part; the margin covers their rounding.
            for row in np.flatnonzero(others & (size @ np.abs(query).astype(np.float64) >= _SAFE / 2)).tolist():
                exact = sum(a * b for a, b in zip(query.tolist(), self.values[row].tolist()))
                if not -(1 << 63) <= exact < 1 << 63:
                    raise OverflowError(f"the score of {name} and {self.ids[row]} does not fit 64 bits: {exact}")
                score[row] = exact
            # ~score is the order of falling scores without the overflow of a negation; rows are in the order of ids.
            rows = np.flatnonzero(others)
            rows = rows[np.argsort(~score[rows], kind="stable")[:k]]
            out += [(name, row, value) for row, value in zip(self.ids[rows].tolist(), score[rows].tolist())]
        return out

    @staticmethod
    def _read(score: Slices, q: int, rows: np.ndarray) -> np.ndarray:
        """The scores of some rows of a query, read off the slices."""
        value = np.zeros(len(rows), np.int64)
        for b, one in enumerate(score):
            bits = ((one[q, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            value += (bits - (b == len(score) - 1)) << b if b == len(score) - 1 else bits << b
        return value


def _rows(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def quantised(vectors: DataFrame) -> DataFrame:
    """``id`` and ``value``, the components as whole numbers, of the rows that take part."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))

    def whole(v: Column) -> Column:
        too_large = F.raise_error(F.concat(F.lit("a component does not fit 64 bits: "), v.cast("string")))
        return F.when(F.abs(v) < 2.0**63 / SCALE, F.floor(v * SCALE).cast("long")).otherwise(too_large.cast("long"))

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & good,
    ).select("id", F.transform(x, whole).alias("value"))


def _grouped(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` rows of one length, without a shuffle: key, length, ids and values as bytes.

    Values have 32 bits, or 64 in the blocks of rows with a large component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, str], list[tuple[int, np.ndarray]]] = {}

        def flush(kind: tuple[int, str]) -> pa.RecordBatch:
            nonlocal made
            rows, (length, form) = held.pop(kind), kind
            made += 1
            return pa.RecordBatch.from_pydict({
                name: pa.array([(part << 32) + made], pa.int64()), "length": pa.array([length], pa.int64()),
                f"{name}_ids": pa.array([np.array([i for i, _ in rows], "<i8").tobytes()], pa.binary()),
                f"{name}_values": pa.array([np.array([v for _, v in rows], form).tobytes()], pa.binary())})

        for batch in batches:
            values = batch.column("value")
            flat, offsets = values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()
            large = np.abs(flat) >= _LARGEST
            for k, i in enumerate(batch.column("id").to_pylist()):
                value = flat[offsets[k]:offsets[k + 1]]
                kind = (len(value), "<i8" if large[offsets[k]:offsets[k + 1]].any() else "<i4")
                # A view would keep the whole batch.
                held.setdefault(kind, []).append((i, value.astype(kind[1])))
                if len(held[kind]) == size:
                    yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    return map_arrow(rows, run, f"{name} long, length long, {name}_ids binary, {name}_values binary")


def _opened(ids: bytes, values: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the rows of values of a block."""
    numbers = np.frombuffer(ids, "<i8")
    form = "<i8" if len(values) == 8 * len(numbers) * length else "<i4"
    return numbers, np.frombuffer(values, form).reshape(-1, length).astype(np.int64)


def search(vectors: DataFrame, k: int = BEST, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the best ``k`` rows for each row whose id is divisible by ``every``."""
    rows = quantised(vectors)
    side = max(2, math.isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lanes = F.sequence(F.lit(0), F.lit(side - 1))
    # A given number of parts: the keys are few bytes for much work, so they must not be put together by their size.
    parts, keys = 2 * side * side, ["x", "y", "length"]
    blocks = _grouped(rows, BLOCK_ROWS, "block").select(
        "*", F.pmod(F.xxhash64("block"), F.lit(side)).cast("int").alias("x"), F.explode(lanes).alias("y"))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("value").alias("value"))
    groups = _grouped(queries, GROUP_ROWS, "query").select(
        "*", F.pmod(F.xxhash64("query"), F.lit(side)).cast("int").alias("y"), F.explode(lanes).alias("x"))
    met = blocks.repartition(parts, *keys).hint("merge").join(groups.repartition(parts, *keys), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int | None, Block | None] = (None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                record = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                length = record["length"]
                if opened[0] != record["block"]:
                    opened = (record["block"], Block(*_opened(record["block_ids"], record["block_values"], length)))
                ids, values = _opened(record["query_ids"], record["query_values"], length)
                found = [x for at in range(0, len(ids), _TOGETHER)
                         for x in opened[1].best(ids[at:at + _TOGETHER], values[at:at + _TOGETHER], k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    met = met.select("block", "length", "block_ids", "block_values", "query_ids", "query_values")
    found = map_arrow(met, run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
