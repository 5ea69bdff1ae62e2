"""Starting, restarting and sizing streaming queries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tarnlake.lake import maintenance
from tarnlake.lake.table import LakeTable
from tarnlake.session import STATE_STORE_CONF, session_conf

# Checkpoint interval, restart attempts and delay, and messages a second for which jobs
# are paced by default. What is not read in one micro-batch is read in the next ones.
INTERVAL = "60 seconds"
ATTEMPTS = 3
RESTART_DELAY_SECONDS = 10.0
MINI_BATCH_ROWS = 1000


@dataclass(frozen=True)
class RunSettings:
    """Where a query keeps its progress and how often it runs.

    ``interval`` None processes everything that is available and stops. ``compact_every`` so many
    versions, the table is compacted if it has small files.
    """

    checkpoint: str
    interval: str | None = INTERVAL
    name: str | None = None
    compact_every: int | None = None


def configured(writer: DataStreamWriter, settings: RunSettings) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", settings.checkpoint)
    if settings.name:
        writer = writer.queryName(settings.name)
    if settings.interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=settings.interval)


def started(
    rows: DataFrame, writer: DataStreamWriter, settings: RunSettings, output_mode: str = "append"
) -> StreamingQuery:
    """Start a query with its state in RocksDB, whatever the session says.

    In update mode a micro-batch without rows has nothing to write: it is left out, and expired
    state goes with the next rows. In append mode it is what closes windows.
    """
    conf = dict(STATE_STORE_CONF)
    conf["spark.sql.streaming.noDataMicroBatches.enabled"] = str(output_mode != "update").lower()
    with session_conf(rows.sparkSession, conf):
        return configured(writer, settings).start()


def upsert_stream(
    rows: DataFrame,
    table: LakeTable,
    settings: RunSettings,
    output_mode: str = "update",
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write a stream to a lake table, one version per micro-batch.

    A batch that is run again after a failure replaces the commit with its name, so every batch counts
    once. In update mode a window is written again whenever it changes and the last row of a key
    wins. ``enrich`` is a batch step on the changed rows, such as a join with a table that is read
    anew each time.
    """
    if output_mode == "update" and not table.spec.keys:
        raise ValueError(f"table {table.spec.name} has no key: changed windows would be added again")

    query_id: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        target = LakeTable(batch.sparkSession, table.spec, table.path)
        # Only the first batch of a run can be one that an earlier run has committed.
        first = not query_id
        if first:
            query_id.append(_query_id(batch, settings))
        target.commit(enrich(batch) if enrich else batch, batch=f"{query_id[0]}-{batch_id}", again=first)
        if settings.compact_every and (batch_id + 1) % settings.compact_every == 0:
            maintenance.compact_if_needed(target)

    writer = rows.writeStream.outputMode(output_mode).foreachBatch(write)
    return started(rows, writer, settings, output_mode)


def _query_id(batch: DataFrame, settings: RunSettings) -> str:
    """The id of the query in its checkpoint: kept over restarts, new for a new checkpoint."""
    metadata = batch.sparkSession.read.text(f"{settings.checkpoint}/metadata").first()
    return json.loads(metadata.value)["id"]


def append_stream(
    rows: DataFrame, path: str, settings: RunSettings, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Append a stream to a folder of Parquet files by partition, exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return started(rows, writer, settings)


def file_sink(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    """One folder per micro-batch, complete when it has its ``_SUCCESS`` marker."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return started(rows, rows.writeStream.outputMode("append").foreachBatch(write), settings)


def on_each_trigger(spark: SparkSession, step: Callable[[], object], settings: RunSettings) -> StreamingQuery | None:
    """Run a step over tables at every interval, or once if there is none.

    A clock drives it, so that the step has the triggers, restarts and name of a query.
    """
    if settings.interval is None:
        step()
        return None
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return configured(clock.writeStream.foreachBatch(lambda batch, batch_id: step()), settings).start()


def run_with_restarts(
    start: Callable[[], StreamingQuery],
    attempts: int = ATTEMPTS,
    delay_seconds: float = RESTART_DELAY_SECONDS,
) -> StreamingQuery:
    """Run a query to its end; after a failure start it again from its checkpoint.

    ``start`` builds and starts the query. The last failure is raised when no attempt is left.
    """
    for attempt in range(attempts + 1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if attempt == attempts:
                raise
            time.sleep(delay_seconds)
    raise AssertionError("unreachable")


def run_together(
    starts: Sequence[Callable[[], StreamingQuery]],
    attempts: int = ATTEMPTS,
    delay_seconds: float = RESTART_DELAY_SECONDS,
    look_every: float = 1.0,
) -> None:
    """Run queries next to each other until all have ended; one that fails is started again from its checkpoint.

    When one has no attempt left, the others are stopped and its failure is raised.
    """
    running = {k: start() for k, start in enumerate(starts)}
    failures = dict.fromkeys(running, 0)
    while running:
        time.sleep(look_every)
        for k, query in list(running.items()):
            if query.isActive:
                continue
            problem = query.exception()
            if problem is None:
                del running[k]
                continue
            failures[k] += 1
            if failures[k] > attempts:
                for other in running.values():
                    other.stop()
                raise problem
            time.sleep(delay_seconds)
            running[k] = starts[k]()
