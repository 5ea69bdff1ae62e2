"""The streaming jobs: a job function, its source rows and its table.

The summaries run in update mode into keyed tables: every micro-batch writes the windows it changed,
and the last row of a key wins, so the tables are as complete as the input. State is bounded by the
watermark. Rows are combined per task before they reach the state store, so a hot key costs one row
per task and batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.lake.table import LakeTable
from tarnlake.plans import behavior, hourly, orders, sales, words
from tarnlake.schemas import Topic
from tarnlake.sources import messages
from tarnlake.streaming.partitions import committed_sink, write_batch
from tarnlake.streaming.runner import RunSettings, append_stream, file_sink, started, upsert_stream


def user_behavior_summary(rows: DataFrame, table: LakeTable, settings: RunSettings) -> StreamingQuery:
    return upsert_stream(behavior.user_behavior_summary(rows), table, settings)


def order_summary(rows: DataFrame, table: LakeTable, settings: RunSettings) -> StreamingQuery:
    return upsert_stream(orders.order_summary(rows), table, settings)


def product_sales_stats(
    rows: DataFrame, products, table: LakeTable, settings: RunSettings
) -> StreamingQuery:
    """Orders are aggregated on the stream; the changed windows join the products as they are at
    that time. ``products`` is called per micro-batch and returns one row per product."""
    return upsert_stream(
        orders.product_windows(rows), table, settings,
        enrich=lambda batch: orders.with_product(batch, products(batch.sparkSession)),
    )


def hourly_aggregations(
    behavior_rows: DataFrame, order_rows: DataFrame, table: LakeTable, settings: RunSettings
) -> StreamingQuery:
    return upsert_stream(hourly.hourly_aggregations(behavior_rows, order_rows), table, settings)


def word_count(rows: DataFrame, table: LakeTable, settings: RunSettings) -> StreamingQuery:
    return upsert_stream(words.word_count_sum(rows), table, settings)


def word_count_files(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    """Finished word windows as Parquet files, a folder per trigger."""
    return file_sink(words.word_count_rows(rows), path, settings)


def word_count_committed(
    rows: DataFrame, path: str, settings: RunSettings, length: str = "1 minute", delay: str = "1 minute"
) -> StreamingQuery:
    """Finished word windows in time partitions, each marked once the watermark is past its end and the delay."""
    return committed_sink(words.word_count_rows(rows), path, settings, "window_start", length, delay)


def user_events_hourly(rows: DataFrame, table: LakeTable, settings: RunSettings) -> StreamingQuery:
    """Exact distinct users per hour: two chained aggregates, which need append mode. A window is
    written once the watermark has passed it."""
    return upsert_stream(behavior.user_events_hourly(rows), table, settings, output_mode="append")


def user_event_counts(rows: DataFrame, table: LakeTable, settings: RunSettings) -> StreamingQuery:
    """Events per user and hour in update mode; ``hourly_from_counts`` over the table gives the
    distinct users without waiting for the watermark."""
    return upsert_stream(behavior.user_event_counts(rows), table, settings)


def user_bitmaps(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    """Distinct users per type and hour as bitmaps, appended by every micro-batch without any state.

    Readers merge the bitmaps of an hour. Rows may come as late as they like.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(behavior.user_bitmaps(batch), path, batch_id)

    return started(rows, rows.writeStream.outputMode("append").foreachBatch(write), settings)


def append_once(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    """Append the rows of a stream; the files of a batch that runs again are replaced."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return started(rows, rows.writeStream.outputMode("append").foreachBatch(write), settings)


def behavior_windows(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    return file_sink(behavior.behavior_windows(rows), path, settings)


def hourly_sales_trend(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    return file_sink(sales.hourly_sales_trend(rows), path, settings)


def ingest_events(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    """User events to a folder partitioned by day."""
    dated = rows.withColumn("event_date", F.to_date("event_time"))
    return append_stream(dated, path, settings, ("event_date",))


def ingest_events_table(rows: DataFrame, table: LakeTable, settings: RunSettings) -> StreamingQuery:
    """User events to their keyed table."""
    return upsert_stream(rows, table, settings, output_mode="append")


def ingest_sales(rows: DataFrame, path: str, settings: RunSettings) -> StreamingQuery:
    """Sales to a folder partitioned by sale day."""
    return append_stream(rows, path, settings, ("sale_date",))


def dead_letters(source: DataFrame, topic: Topic, path: str, settings: RunSettings) -> StreamingQuery:
    """The messages of a topic that no job can use, with the reason, in one folder per micro-batch.

    It runs next to the topic's jobs with progress of its own, so their state does not depend on it.
    """
    decoded = messages.decode(source, topic.schema)
    return file_sink(messages.dead_letters(decoded, topic.event_time), path, settings)


def take_in(source: DataFrame, topic: Topic, good: str, bad: str, settings: RunSettings) -> StreamingQuery:
    """The messages of a topic, each once: usable rows in one folder, the others with the reason in another.

    One query reads the topic once and writes both sides of the same micro-batch, so no message can
    fall between them, whenever the query starts, fails or is started again. A batch that runs again
    replaces its own files on both sides.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = messages.decode(batch, topic.schema).persist()
        try:
            write_batch(messages.good_rows(decoded, topic.event_time), good, batch_id)
            write_batch(messages.dead_letters(decoded, topic.event_time), bad, batch_id)
        finally:
            decoded.unpersist()

    return started(source, source.writeStream.outputMode("append").foreachBatch(write), settings)


def orders_with_products(
    order_rows: DataFrame, product_rows: DataFrame, horizon: str = "1 hour", spread: int = 8
) -> DataFrame:
    """Orders left-joined with the product updates of the time before them, stream to stream.

    A stream join needs a time range to bound its state. An order joins every update of its product
    in the ``horizon`` before it. The join state of a product is split over ``spread`` parts: each
    order goes to one part and product updates, which are few, to all of them.
    """
    o = order_rows.withColumn("part", F.pmod(F.hash("order_id"), F.lit(spread))).alias("o")
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part")
    p = product_rows.select("product_id", "product_name", "category", "update_time", copies).alias("p")
    near = (
        (F.col("o.product_id") == F.col("p.product_id"))
        & (F.col("o.part") == F.col("p.part"))
        & (F.col("p.update_time") <= F.col("o.order_time"))
        & (F.col("p.update_time") >= F.col("o.order_time") - F.expr(f"INTERVAL {horizon}"))
    )
    return o.join(p, near, "leftOuter").select("o.*", "p.product_name", "p.category", "p.update_time").drop("part")
