"""Small helpers that the operators share."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import scratch_dir

DEFAULT_VOCABULARIES = "/opt/tokenizers"
# A side is broadcast up to so many bytes, counted before the join; beyond it the join is left to a shuffle.
BROADCAST_BYTES = 32 << 20
# Python works on so many bytes of text at a time, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


def vocabulary(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file is; ``folder`` defaults to the installed ones."""
    if folder is None:
        try:
            import public_tokenizers
        except ImportError:
            return os.path.join(DEFAULT_VOCABULARIES, name)
        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def fresh(taken: list[str], wanted: str) -> str:
    """``wanted``, or with the first number that makes it differ from all names in ``taken``."""
    lower = {name.lower() for name in taken}
    name, number = wanted, 0
    while name.lower() in lower:
        number += 1
        name = f"{wanted}_{number}"
    return name


def bounded_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` if its counted rows fit the bound; else leave the join to the optimizer."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def slices(
    batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, most_rows: int = 4096,
) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text and at most ``most_rows`` rows, at least one row each."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and (held + size > most or row - start == most_rows):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def write_shared(spark: SparkSession, folder: str, name: str, data: bytes) -> str:
    """Write a small file into a folder that all executors reach, through Spark's own file systems; its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    file = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    file.write(bytearray(data))
    file.close()
    return path.toString()


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(write_shared(spark, scratch_dir(spark, "package", keep=True), "tarnlake.zip", data.getvalue()))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` for a function of this package."""
    _ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


class Remembered(dict):
    """Results by piece of text, of which the recently used ones are kept; memory is bounded.

    There are two tables: a full one becomes the old one, from which entries come back when they are used.
    """

    MOST = 150_000
    LONGEST = 48

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.result(piece)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def result(self, piece: str) -> bytes:
        raise NotImplementedError


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]

