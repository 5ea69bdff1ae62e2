"""Files of token ids: the ids of many documents one after the other, with their boundaries in few bits.

A block holds up to about a million ids in 16 bits each. The ends of its documents are a rising sequence,
stored by Elias and Fano: the low bits of every end as they are, the high bits in unary, which together take
about two bits more per document than the least possible, and no table of 64-bit offsets. The position of
every 64th one in the unary part is kept, so that ``Boundaries.end(i)`` finds an end without reading the rest, and
``Boundaries.values`` many at once; all reads go through them. The ids of the documents, which rise too, are stored alike.

Blocks are rows of a Parquet table, so the files can lie wherever Spark writes. Documents are sorted by id over all
files (range partitions); a document's start is the sum of the ids in earlier blocks, from prefix sums
over one number per block.

Edge cases: a null or empty text is its end id alone; null ids come first; equal ids are ordered by a hash of
their texts; a text longer than a block gets a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import bounded_broadcast, map_arrow, slices, vocabulary
from tarnlake.llm.tokens import encoder
from tarnlake.session import scratch_dir

END_ID = 2
BLOCK_IDS = 1 << 20
SAMPLE = 64
MAGIC = b"TNIDS\x02"
# Magic, low bits of the boundaries and of the documents' ids, documents, null ids among them, token ids, bytes of both
# unary parts, the least of the documents' ids.
_HEADER = struct.Struct("<6sBBQQQQQq")
# Where the k-th one of a byte is.
_PLACE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(b for b in range(8) if _byte >> b & 1):
        _PLACE[_byte, _k] = _at


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, least significant first."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class Boundaries:
    """The ends of documents in a rising sequence, as low bits, unary high bits and samples."""

    def __init__(self, low: bytes, high: bytes, samples: np.ndarray, width: int, n: int):
        self.low, self.high, self.samples, self.width, self.n = low, np.frombuffer(high, np.uint8), samples, width, n

    @staticmethod
    def of(ends: np.ndarray) -> Boundaries:
        n, most = len(ends), int(ends[-1]) if len(ends) else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        ends = ends.astype(np.uint64)
        ones = (ends >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return Boundaries(_pack(ends, width), np.packbits(bits, bitorder="little").tobytes(),
                          ones[::SAMPLE].astype("<u4"), width, n)

    def _low(self, i: int) -> int:
        first, last = i * self.width, (i + 1) * self.width
        part = int.from_bytes(self.low[first // 8:(last + 7) // 8], "little")
        return (part >> (first % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The position of the i-th one of the unary part, from the last sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at // 8, int(self.high[at // 8]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def end(self, i: int) -> int:
        """Where document ``i`` ends."""
        return ((self.select(i) - i) << self.width) | self._low(i)

    def selects(self, i: np.ndarray) -> np.ndarray:
        """``select`` of many at once: each goes on from its own sample, byte by byte, and few go far."""
        at, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        byte = at // 8
        word = self.high[byte] & (0xFF << (at % 8)).astype(np.uint8)
        ones = np.bitwise_count(word).astype(np.int64)
        going = np.flatnonzero(ones <= left)
        while len(going):
            left[going] -= ones[going]
            byte[going] += 1
            word[going] = self.high[byte[going]]
            ones[going] = np.bitwise_count(word[going])
            going = going[ones[going] <= left[going]]
        return byte * 8 + _PLACE[word, left]

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at many places (unsigned): where these documents end."""
        high = (self.selects(i) - i).astype(np.uint64) << np.uint64(self.width)
        low, packed = np.zeros(len(i), np.uint64), np.frombuffer(self.low, np.uint8)
        for bit in range(self.width):
            place = i * self.width + bit
            low |= ((packed[place // 8] >> (place % 8).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(bit)
        return high | low


def write_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A block of documents in ascending order of their ids, of which null ids come first."""
    bounds = Boundaries.of(np.cumsum([len(x) for x in ids]))
    least = next((d for d in doc_ids if d is not None), 0)
    names = Boundaries.of(np.array([0 if d is None else d - least for d in doc_ids], np.uint64))
    return b"".join([
        _HEADER.pack(MAGIC, bounds.width, names.width, bounds.n, sum(d is None for d in doc_ids), sum(map(len, ids)),
                     len(bounds.high), len(names.high), least),
        *[part for rising in (bounds, names) for part in (rising.samples.tobytes(), rising.high.tobytes(), rising.low)],
        *[np.ascontiguousarray(x, "<u2").tobytes() for x in ids]])


class Block:
    """A block as it lies in a file: single documents are found by select, without a table of offsets."""

    def __init__(self, blob: bytes):
        magic, width, name_width, self.n, self.nulls, total, high, name_high, self.least = _HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at, rising = _HEADER.size, []
        for bits, unary in ((width, high), (name_width, name_high)):
            parts = []
            for size in (4 * -(-self.n // SAMPLE), unary, -(-self.n * bits // 8)):
                parts.append(blob[at:at + size])
                at += size
            rising.append(Boundaries(parts[2], parts[1], np.frombuffer(parts[0], "<u4"), bits, self.n))
        self.bounds, self.names = rising
        self.ids = np.frombuffer(blob, "<u2", total, at)

    def ends(self, i: np.ndarray) -> np.ndarray:
        return self.bounds.values(i).astype(np.int64)

    def doc_ids(self, i: np.ndarray) -> list[int | None]:
        return [None if k < self.nulls else value + self.least for k, value in zip(i.tolist(), self.names.values(i).tolist())]

    def document(self, i: int) -> np.ndarray:
        """The token ids of one document."""
        first, last = (self.bounds.end(i - 1) if i else 0), self.bounds.end(i)
        return self.ids[first:last]


def write(docs: DataFrame, path: str, end_id: int = END_ID, vocabularies: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode doc_id and text of ``docs`` and write their blocks below ``path`` in the order of the ids.

    A block has at most ``block_ids`` token ids, or one document.
    """
    tokenizer = vocabulary("byte_bpe_50k.json", vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "block": pa.array([block], pa.int64()),
                "n_ids": pa.array([size], pa.int64()), "blob": pa.array([write_block(names, held)], pa.binary())})

        for batch in (s for b in batches for s in slices(b, "text")):
            texts = batch.column("text").to_pylist()
            for name, ids in zip(batch.column("doc_id").to_pylist(), encode.ended(texts, end_id)):
                if held and size + len(ids) > block_ids:
                    yield flush()
                    names, held, size, block = [], [], 0, block + 1
                names.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    keyed = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    map_arrow(keyed, run, "part long, block long, n_ids long, blob binary").write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and its ids as 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, base in zip(batch.column("blob"), batch.column("base").to_pylist()):
                block = Block(blob.as_py())
                every = np.arange(block.n)
                names, ends = block.doc_ids(every), block.ends(every)
                starts = np.concatenate([[0], ends[:-1]])
                parts = [block.ids[a:b] for a, b in zip(starts, ends)]
                out = {
                    "doc_id": pa.array(names, pa.int64()), "start": pa.array(base + starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    blocks = spark.read.schema("part long, block long, n_ids long, blob binary").parquet(path)
    # One row per partition, then one per block; the ids are not read for it.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    index = (blocks.select("part", "block", "n_ids", inner.alias("inner")).join(parts, "part")
             .select("part", "block", (F.col("before") + F.col("inner")).alias("base")))
    placed = blocks.join(bounded_broadcast(index, 24), ["part", "block"]).select("blob", "base")
    return map_arrow(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def report(docs: DataFrame) -> DataFrame:
    """The documents as read back from their files."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write(docs, path)
    return read(docs.sparkSession, path, with_ids=False)
