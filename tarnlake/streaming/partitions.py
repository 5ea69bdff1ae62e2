"""A Parquet sink whose time partitions are marked finished when the watermark has passed them.

A partition is open as long as rows for it may still come. When the watermark of a batch has reached the partition's end plus
a delay, every row of it is written, and it gets a ``_SUCCESS`` file of its own: a consumer that waits for the marker reads
whole partitions only, whatever the batches were.

Each batch writes below its own number inside the partitions it touches, by Spark's dynamic partition overwrite, so a batch
that runs again replaces its own files and no others. The watermark of a batch is the one Spark has recorded for it in the
checkpoint before it ran: after a failure the same batch finds the same one. The partitions that stay open are
written next to the data, one small file per batch; there are as many as the lateness and the delay hold.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.functions import interval_seconds
from tarnlake.streaming.runner import RunSettings, started

PART, BATCH, MARKER = "part", "batch", "_SUCCESS"
# Where the open partitions of each batch are listed; readers of the data skip names with an underscore.
_OPEN = "_open"
_NAME = "yyyy-MM-dd'T'HH-mm-ss"


def batch_watermark(spark: SparkSession, checkpoint: str, batch_id: int) -> datetime | None:
    """The watermark with which a batch runs, from the checkpoint; None before there is one."""
    text = spark.read.text(f"{checkpoint}/offsets/{batch_id}", wholetext=True).first().value
    # A line with the version of the file, one with the batch's metadata, then one per source.
    millis = json.loads(text.split("\n")[1])["batchWatermarkMs"]
    return datetime.fromtimestamp(millis / 1000, timezone.utc) if millis > 0 else None


def write_batch(batch: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """The rows of a batch, in files of its own inside the partitions; once more gives the same files."""
    if partition_by:
        # About one file per partition and batch; a large partition is split over several.
        batch = batch.hint("rebalance", *partition_by)
    (batch.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by, BATCH).parquet(path))


def part_start(time: Column, seconds: int) -> Column:
    """The start of the time partition of a moment."""
    return F.timestamp_seconds(F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _mark(spark: SparkSession, folder: str) -> None:
    where, files = _file_system(spark, f"{folder}/{MARKER}")
    files.create(where, True).close()


def committed_sink(
    rows: DataFrame, path: str, settings: RunSettings, time_column: str, length: str = "1 hour", delay: str = "1 minute",
) -> StreamingQuery:
    """Write an append-mode stream into partitions of ``length`` by ``time_column`` and mark the finished ones.

    Rows without a time go to Hive's default partition, which is never finished.
    """
    seconds, wait = interval_seconds(length), interval_seconds(delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = part_start(F.col(time_column), seconds)
        dated = batch.withColumn(PART, F.date_format(start, _NAME)).persist()
        try:
            write_batch(dated, path, batch_id, (PART,))
            touched = dated.select(PART, start.alias("start")).where("start IS NOT NULL").distinct()
            before = open_partitions(spark, path, batch_id - 1)
            known = touched if before is None else touched.union(before).distinct()
            watermark = batch_watermark(spark, settings.checkpoint, batch_id)
            done = F.lit(False) if watermark is None else (
                F.unix_micros("start") + (seconds + wait) * 1_000_000 <= round(watermark.timestamp() * 1_000_000))
            judged = known.withColumn("done", done)
            # As many names as partitions end between two watermarks.
            for row in judged.where("done").collect():
                _mark(spark, f"{path}/{PART}={row[PART]}")
            judged.where("NOT done").drop("done").coalesce(1).write.mode("overwrite").parquet(f"{path}/{_OPEN}/{BATCH}={batch_id}")
        finally:
            dated.unpersist()

    return started(rows, rows.writeStream.outputMode("append").foreachBatch(write), settings)


def open_partitions(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """``part`` and ``start`` of the partitions that were open after a batch; None if there was no such batch."""
    where, files = _file_system(spark, f"{path}/{_OPEN}/{BATCH}={batch_id}/{MARKER}")
    if batch_id < 0 or not files.exists(where):
        return None
    return spark.read.parquet(f"{path}/{_OPEN}/{BATCH}={batch_id}")


def finished(spark: SparkSession, path: str) -> list[str]:
    """The names of the finished partitions, from one listing."""
    where, files = _file_system(spark, f"{path}/{PART}=*/{MARKER}")
    found = files.globStatus(where) or []
    return sorted(status.getPath().getParent().getName().partition("=")[2] for status in found)


def read_finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the finished partitions, without any of the open ones."""
    parts = finished(spark, path)
    if not parts:
        return spark.createDataFrame([], f"{schema}, {PART} string")
    folders = [f"{path}/{PART}={part}" for part in parts]
    return spark.read.option("basePath", path).schema(f"{schema}, {PART} string, {BATCH} long").parquet(*folders).drop(BATCH)
