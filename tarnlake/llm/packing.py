"""Packing by concatenation: all token ids in one long row, cut into sequences of equal length.

Two passes. The first encodes every partition once and writes its documents with the number of ids before
them in their partition. The prefix sums of the partitions' totals then give each document its place in the
long row. The second pass cuts at the multiples of the sequence length: a document that crosses a cut
becomes several pieces, its boundary records. Only one number per partition is ever brought together.

Edge cases: a null or empty text is its end id alone; equal rows are packed once each; a very long text
spans many sequences; an empty table gives no pieces. Names of further columns cannot clash, as only the id
and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import bounded_broadcast, map_arrow, slices, vocabulary
from tarnlake.llm.tokens import encoder
from tarnlake.session import stored

SEQUENCE = 1024
END_ID = 0
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padding long, ids binary")


def encode_partitions(docs: DataFrame, end_id: int, path: str) -> DataFrame:
    """Per document its ids (16 bits each, with the end id), their number and how many precede them in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in (s for b in batches for s in slices(b, "text")):
            ids = encode.ended(batch.column("text").to_pylist(), end_id)
            n = np.array([len(x) for x in ids], np.int64)
            upto = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part)), pa.array(upto - n), pa.array(n),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "part", "before", "n", "ids"])
            before = int(upto[-1])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"),
                     run, "doc_id long, part long, before long, n long, ids binary")


def placed(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``at``: the number of ids before the document in all partitions."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition of the input.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return (encoded.join(bounded_broadcast(offsets, 16), "part")
            .select("doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("at")))


def cut(documents: DataFrame, total: int, length: int = SEQUENCE) -> DataFrame:
    """The pieces of placed documents. Only the last sequence can be short; its padding is counted there."""
    last, short = (total - 1) // length, (total - 1) % length + 1
    pad = 0 if short & (short - 1) == 0 else length - short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
            held = 0
            for doc, n, blob, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at"))):
                ids = np.frombuffer(blob, "<u2")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    part = ids[start:start + size]
                    for name, value in zip(rows, (
                            doc, start, size, zlib.crc32(part.astype("<u4").tobytes()), n, sequence, offset,
                            pad if sequence == last else 0, part.tobytes())):
                        rows[name].append(value)
                    start += size
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, _kind(k)) for k, v in rows.items()], list(rows))
                    rows, held = {name: [] for name in rows}, 0
            yield pa.RecordBatch.from_arrays([pa.array(v, _kind(k)) for k, v in rows.items()], list(rows))

    return map_arrow(documents, run, PIECES)


def _kind(name: str) -> pa.DataType:
    return pa.binary() if name == "ids" else pa.int64()


def pack(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, vocabularies: str | None = None) -> DataFrame:
    """All documents of ``docs`` (columns doc_id and text) as pieces of gapless sequences of ``length`` ids.

    ``sequence_id`` and ``offset`` place a piece, ``ids`` holds its ids, ``padding`` is what fills up its sequence.
    """
    encoded = stored(
        encode_partitions(docs, end_id, vocabulary("byte_bpe_50k.json", vocabularies)), "packing-ids")
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return cut(placed(encoded), total, length)


def report(docs: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs).drop("ids")
