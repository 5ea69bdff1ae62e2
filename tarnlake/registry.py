"""Every registered query: a function of the session and the folder of the Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions import ntz_columns, since
from tarnlake.lake import LakeTable, changelog, maintenance
from tarnlake.operators import bitmaps, histogram, latest_per_key, timeseries
from tarnlake.plans import (
    behavior, forest, hourly, logs, orders, payloads, profile, quality, sales, staged, words,
)
from tarnlake.schemas import TABLES, TOPICS, TableSpec, _schema
from tarnlake.session import scratch_dir, stored
from tarnlake.sources import external, messages, tables
from tarnlake.streaming import chains, jobs, metrics, partitions, state
from tarnlake.streaming.runner import RunSettings, run_together, started, upsert_stream

Query = Callable[[SparkSession, str], DataFrame]

# The moment that stands for "now": shortly after the last event of the tables.
AS_OF = "2024-01-30 23:57:30"
# A moment with purchases in the half hour before it.
BUSY = "2024-01-30 23:30:00"
DAY = "1 day"
# Labels of event types; "refund" has no events.
EVENT_LABELS = [
    ("view", "interest"), ("click", "interest"), ("purchase", "sale"), ("refund", "sale"), ("signup", "account"),
]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[function.__name__] = function
    return function


def _behavior_summary(spark: SparkSession, sf: str) -> DataFrame:
    return behavior.user_behavior_summary(tables.user_behavior(spark, sf))


def _order_summary(spark: SparkSession, sf: str) -> DataFrame:
    return orders.order_summary(tables.orders(spark, sf))


def _product_stats(spark: SparkSession, sf: str) -> DataFrame:
    return orders.product_sales_stats(tables.orders(spark, sf), tables.products(spark, sf))


def _recent(rows: DataFrame, time_column: str, look_back: str, as_of: str = AS_OF) -> DataFrame:
    """Rows that can be in a window that starts within the look-back.

    A window holds only rows after its start, so windows within the look-back keep all their rows;
    unlike the filter on the window, this one reaches the Parquet scan.
    """
    return rows.where(since(rows, time_column, as_of, look_back))


def _recent_summaries(spark, sf, look_back: str, as_of: str = AS_OF) -> tuple[DataFrame, DataFrame]:
    return (
        behavior.user_behavior_summary(_recent(tables.user_behavior(spark, sf), "ts", look_back, as_of)),
        orders.order_summary(_recent(tables.orders(spark, sf), "order_time", look_back, as_of)),
    )


def _recent_products(spark, sf, look_back: str, as_of: str = AS_OF) -> DataFrame:
    rows = _recent(tables.orders(spark, sf), "order_time", look_back, as_of)
    return orders.product_sales_stats(rows, tables.products(spark, sf))


def _profile_changes(spark, sf, look_back: str, as_of: str = AS_OF) -> DataFrame:
    return profile.user_profile_changes(*_recent_summaries(spark, sf, look_back, as_of), as_of, look_back)


# --- windowed summaries -----------------------------------------------------------------------

@query
def user_behavior_summary(spark, sf):
    return _behavior_summary(spark, sf)


@query
def order_summary(spark, sf):
    return _order_summary(spark, sf)


@query
def order_summary_bulk(spark, sf):
    return orders.order_summary(tables.orders_bulk(spark, sf))


@query
def product_sales_stats(spark, sf):
    return _product_stats(spark, sf)


@query
def product_sales_stats_bulk(spark, sf):
    return orders.product_sales_stats(tables.orders_bulk(spark, sf), tables.products(spark, sf))


@query
def user_behavior_wide(spark, sf):
    return behavior.user_behavior_wide(_behavior_summary(spark, sf), _order_summary(spark, sf))


@query
def hourly_aggregations(spark, sf):
    return hourly.hourly_aggregations(tables.user_behavior(spark, sf), tables.orders(spark, sf))


@query
def hourly_aggregations_bulk(spark, sf):
    return hourly.hourly_aggregations(tables.user_behavior(spark, sf), tables.orders_bulk(spark, sf))


@query
def user_events_hourly(spark, sf):
    return behavior.user_events_hourly(tables.user_events(spark, sf))


def _hourly_bitmaps(spark, sf) -> DataFrame:
    """The distinct users of every type and hour, stored as bitmaps."""
    return stored(behavior.user_bitmaps(tables.user_events(spark, sf)), "user-bitmaps")


@query
def distinct_users_hourly(spark, sf):
    return behavior.distinct_users(_hourly_bitmaps(spark, sf), "hour")


@query
def distinct_users_rollup(spark, sf):
    """Distinct users by day out of the hours."""
    return behavior.distinct_users(_hourly_bitmaps(spark, sf), "day")


@query
def distinct_users_weekly(spark, sf):
    """Distinct users by week and of all types out of the hours."""
    return behavior.distinct_users(_hourly_bitmaps(spark, sf), "week", by_type=False)


@query
def behavior_windows(spark, sf):
    return behavior.behavior_windows(tables.user_events(spark, sf))


@query
def word_count_sum(spark, sf):
    return words.word_count_sum(tables.word_count_input(spark, sf))


@query
def word_count_rows(spark, sf):
    return words.word_count_rows(tables.word_count_input(spark, sf))


@query
def orders_with_product_then(spark, sf):
    """Orders with name, category and price of the product as they were at the time of the order."""
    updates = tables.product_updates_from(tables.table(spark, sf, "events"))
    return orders.orders_with_product_then(tables.orders(spark, sf), updates, "6 hours")


@query
def product_sales_then(spark, sf):
    """Sales per window and the category that the product had when it was ordered."""
    updates = tables.product_updates_from(tables.table(spark, sf, "events"))
    return orders.product_sales_then(tables.orders(spark, sf), updates, "6 hours")


# --- profiles and recommendations -------------------------------------------------------------

@query
def user_profile_changes(spark, sf):
    return _profile_changes(spark, sf, "1 hour")


@query
def user_profile_changes_day(spark, sf):
    return _profile_changes(spark, sf, DAY)


@query
def user_profile(spark, sf):
    return profile.user_profile(_profile_changes(spark, sf, "1 hour"))


@query
def user_profile_day(spark, sf):
    return profile.user_profile(_profile_changes(spark, sf, DAY))


@query
def recommendation_candidates(spark, sf):
    return profile.recommendation_candidates(
        profile.user_profile(_profile_changes(spark, sf, "1 hour")),
        _recent_products(spark, sf, "1 hour"), AS_OF,
    )


@query
def recommendation_candidates_day(spark, sf):
    return profile.recommendation_candidates(
        profile.user_profile(_profile_changes(spark, sf, DAY)), _recent_products(spark, sf, DAY),
        AS_OF, DAY, DAY,
    )


@query
def recommendations(spark, sf):
    return profile.recommendations(
        profile.user_profile(_profile_changes(spark, sf, "1 hour")),
        _recent_products(spark, sf, "1 hour"), AS_OF,
    )


@query
def recommendations_day(spark, sf):
    return profile.recommendations(
        profile.user_profile(_profile_changes(spark, sf, DAY)), _recent_products(spark, sf, DAY),
        AS_OF, DAY, DAY,
    )


def _busy(spark, sf):
    profiles = profile.user_profile(_profile_changes(spark, sf, "1 hour", BUSY))
    return profiles, _recent_products(spark, sf, "1 hour", BUSY), BUSY


@query
def recommendation_candidates_busy(spark, sf):
    return profile.recommendation_candidates(*_busy(spark, sf))


@query
def recommendations_busy(spark, sf):
    return profile.recommendations(*_busy(spark, sf))


# --- quality and monitoring -------------------------------------------------------------------

def _record_counts(spark, sf, look_back):
    behavior_rows, order_rows = _recent_summaries(spark, sf, look_back)
    return quality.dq_record_count(
        {"user_behavior_summary": behavior_rows, "order_summary": order_rows}, AS_OF, look_back
    )


@query
def dq_record_count(spark, sf):
    return _record_counts(spark, sf, "1 hour")


@query
def dq_record_count_day(spark, sf):
    return _record_counts(spark, sf, DAY)


@query
def dq_completeness(spark, sf):
    return quality.dq_completeness(tables.user_events(spark, sf), AS_OF)


@query
def table_metrics(spark, sf):
    return quality.table_metrics(tables.user_events(spark, sf), AS_OF)


@query
def table_row_counts(spark, sf):
    return quality.table_row_counts({
        "user_events": tables.user_events(spark, sf),
        "sales_data": tables.order_lines(spark, sf),
        "word_count": words.word_count_sum(tables.word_count_input(spark, sf)),
    })


@query
def system_monitoring(spark, sf):
    return quality.system_monitoring(tables.user_behavior(spark, sf), AS_OF)


@query
def system_monitoring_day(spark, sf):
    return quality.system_monitoring(tables.user_behavior(spark, sf), AS_OF, DAY)


# --- reports ----------------------------------------------------------------------------------

@query
def events_of_day(spark, sf):
    return behavior.events_of_day(tables.user_events(spark, sf), "2024-01-01")


@query
def any_ten_events(spark, sf):
    """LIMIT without an order: which rows come is not defined."""
    return tables.user_events(spark, sf).limit(10)


@query
def events_per_type(spark, sf):
    return behavior.events_per_type(tables.user_events(spark, sf))


@query
def events_per_label(spark, sf):
    """Events per label, of labels that are written in the job."""
    schema = _schema(event_type=T.StringType(), label=T.StringType())
    labels = external.literal_rows(spark, schema, EVENT_LABELS)
    return behavior.events_per_label(tables.user_events(spark, sf), labels)


@query
def events_to_expire(spark, sf):
    return behavior.events_before(tables.user_events(spark, sf), AS_OF, 7)


@query
def event_payload(spark, sf):
    return behavior.payload_field(tables.user_events(spark, sf), "k")


@query
def payload_shapes(spark, sf):
    return payloads.payload_shapes(tables.payloads(spark, sf), "event_type", "payload")


@query
def payload_values(spark, sf):
    found = payloads.payload_values(tables.payloads(spark, sf), "payload", {
        "total": ("$.total", "decimal(10,2)"), "first_item": ("$.items[0].id", "bigint"), "page": ("$.page", "string"),
        "inner_key": ("$.props.k", "bigint"), "gift": ("$.gift", "boolean")})
    return found.drop("payload")


@query
def sales_by_category(spark, sf):
    return sales.sales_by_category(tables.sales_data(spark, sf))


@query
def sales_of_last_days(spark, sf):
    return sales.sales_of_last_days(tables.sales_data(spark, sf), AS_OF)


@query
def sales_summary(spark, sf):
    return sales.sales_summary(tables.sales_data(spark, sf))


@query
def hourly_sales_trend(spark, sf):
    return sales.hourly_sales_trend(tables.sales_data(spark, sf))


@query
def purchase_sales(spark, sf):
    events = tables.user_events(spark, sf)
    keys = sales.purchases(events).select(F.col("user_id").alias("id"), F.col("event_date").alias("sale_date"))
    return sales.purchase_sales(events, tables.sales_data(spark, sf, only=keys))


def _sales_by_day(spark, sf) -> DataFrame:
    """A copy of the sales in a folder per day."""
    path = scratch_dir(spark, "sales-by-day")
    sales.write_by_day(tables.sales_data(spark, sf), path)
    return spark.read.parquet(path)


@query
def purchase_sales_of_days(spark, sf):
    """The largest purchases with the sales of their id and day; only the folders of their days are read."""
    large = tables.user_events(spark, sf).join(
        tables.table(spark, sf, "events").where("value >= 200").select("user_id", F.col("ts").alias("event_time")),
        ["user_id", "event_time"], "left_semi")
    return sales.purchase_sales_of_days(large, _sales_by_day(spark, sf))


@query
def top_words(spark, sf):
    return words.top_words(words.word_count_sum(tables.word_count_input(spark, sf)))


@query
def top_text_words(spark, sf):
    return words.top_words(words.text_word_count(tables.table(spark, sf, "documents")))


@query
def text_word_count(spark, sf):
    return words.text_word_count(tables.table(spark, sf, "documents"))


@query
def text_word_count_unicode(spark, sf):
    return words.text_word_count(tables.table(spark, sf, "documents"), pattern=words.UNICODE_WORDS)


@query
def distinct_products(spark, sf):
    return tables.orders(spark, sf).select("product_id").distinct()


@query
def latest_event_per_user(spark, sf):
    events = tables.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"])


# --- time series ------------------------------------------------------------------------------

def _by_job(samples, *columns):
    return samples.select(F.col("labels")["job_name"].alias("job_name"), "ts", *columns)


@query
def metric_rate(spark, sf):
    rates = timeseries.rate(tables.metric_samples(spark, sf), "records_total")
    return _by_job(rates, F.round("value", 6).alias("rate"))


@query
def metric_percent(spark, sf):
    used = timeseries.percent_of(tables.metric_samples(spark, sf), "heap_used", "heap_max")
    return _by_job(timeseries.with_threshold(used), F.round("value", 6).alias("percent"), "level")


@query
def metric_latest(spark, sf):
    return _by_job(timeseries.latest_samples(tables.metric_samples(spark, sf), "heap_used"), "value")


@query
def metric_range(spark, sf):
    samples = tables.metric_samples(spark, sf)
    chosen = timeseries.range_select(samples, "heap_used", "2024-01-01 01:00:00")
    return chosen.select(timeseries.legend("Heap Used - {{job_name}}").alias("legend"), "ts", "value")


@query
def metric_grid(spark, sf):
    return _by_job(timeseries.on_grid(tables.metric_samples(spark, sf), "heap_used", "1 minute"), "value")


@query
def metric_steps(spark, sf):
    """Every series at every step of ten minutes, with the gaps."""
    found = timeseries.at_steps(
        tables.value_samples(spark, sf), "event_value", "2024-01-01 00:00:00", "2024-01-30 23:50:00", "10 minutes", gaps=True)
    return found.select(F.col("labels")["event_type"].alias("event_type"), "ts", "value")


@query
def metric_steps_sparse(spark, sf):
    """The same without rows for gaps, of a longer look-back than a slice of time."""
    found = timeseries.at_steps(
        tables.value_samples(spark, sf), "event_value", "2024-01-02 00:00:30", "2024-01-20 12:00:00", "7 minutes",
        "30 minutes", "10 minutes")
    return found.select(F.col("labels")["event_type"].alias("event_type"), "ts", "value")


# --- logs and cluster events ------------------------------------------------------------------

def _error_scan(spark, sf, look_back):
    return logs.error_scan(tables.log_lines(spark, sf), tables.services(spark), AS_OF, look_back)


@query
def log_error_scan(spark, sf):
    return _error_scan(spark, sf, "1 hour")


@query
def log_error_scan_day(spark, sf):
    return _error_scan(spark, sf, DAY)


@query
def latest_cluster_events(spark, sf):
    return logs.latest_events(tables.cluster_events(spark, sf), 20)


@query
def latest_error_events(spark, sf):
    return logs.latest_events(tables.cluster_events(spark, sf), 10, logs.ERROR_EVENTS)


@query
def latest_warning_events(spark, sf):
    return logs.latest_events(tables.cluster_events(spark, sf), 10, logs.WARNING_EVENTS)


@query
def status_rollup(spark, sf):
    return logs.status_rollup(tables.cluster_events(spark, sf))


@query
def problem_items(spark, sf):
    return logs.problem_items(tables.cluster_events(spark, sf))


# --- training ---------------------------------------------------------------------------------

@query
def quality_forest(spark, sf):
    features = forest.text_features(
        tables.table(spark, sf, "documents"), tables.table(spark, sf, "labels")
    )
    # Training makes several passes over its input: the texts are split once.
    return forest.train_forest(stored(features, "features"), "quality", "doc_id")


@query
def quality_forest_split(spark, sf):
    """How many rows are trained on and tested with: the split is the same in every engine."""
    rows = tables.table(spark, sf, "documents").select("doc_id").join(
        tables.table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id"), "doc_id")
    train, test = forest.split_rows(rows, "doc_id")
    both = train.select(F.lit("train").alias("part")).unionAll(test.select(F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count("*").alias("row_count"))


# --- change logs ------------------------------------------------------------------------------

_USER = ["user_id"]
_USER_ORDER = ["event_time", "event_id"]


@query
def lake_current_state(spark, sf):
    return changelog.current_state(tables.user_changes(spark, sf), _USER, _USER_ORDER)


@query
def lake_state_at_version(spark, sf):
    log = changelog.upto_version(tables.user_changes(spark, sf), 10)
    return changelog.current_state(log, _USER, _USER_ORDER)


@query
def lake_state_at_time(spark, sf):
    log = changelog.upto_time(tables.user_changes(spark, sf), "2024-01-05 12:00:00")
    return changelog.current_state(log, _USER, _USER_ORDER)


@query
def lake_changes_between(spark, sf):
    return changelog.between_versions(tables.user_changes(spark, sf), 5, 10)


@query
def lake_change_log(spark, sf):
    return tables.user_changes(spark, sf)


@query
def lake_snapshots(spark, sf):
    return changelog.snapshots(tables.user_changes(spark, sf))


@query
def lake_delete_where(spark, sf):
    state = changelog.current_state(tables.user_changes(spark, sf), _USER, _USER_ORDER)
    return changelog.delete_changes(state, F.col("event_type") == "view")


@query
def lake_latest_order_lines(spark, sf):
    """A large log whose key is repeated: the line shipped last stays."""
    return latest_per_key(
        tables.order_lines(spark, sf), ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
    )


@query
def lake_column_statistics(spark, sf):
    events = tables.table(spark, sf, "events")
    return maintenance.column_statistics(events, events.columns, exact=True)


@query
def lake_column_bounds(spark, sf):
    """Ten buckets of equal height of every numeric column of the order lines."""
    rows = tables.table(spark, sf, "lineitem")
    numeric = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    return histogram.equi_height(rows, numeric, 10)


# --- lake tables on storage -------------------------------------------------------------------

def _orders_spec(spark, sf) -> TableSpec:
    schema = tables.table(spark, sf, "orders").schema
    return TableSpec(
        "orders", schema, ("o_orderkey",), order_by=("o_orderdate",), bucket_by="o_orderkey", buckets=8
    )


def _orders_table(spark, sf) -> LakeTable:
    """All orders, then new prices for finished ones, a deletion, and open ones put back."""
    rows = tables.table(spark, sf, "orders")
    target = LakeTable(spark, _orders_spec(spark, sf), scratch_dir(spark, "orders")).create()
    target.commit(rows)
    target.commit(rows.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    target.delete_where(F.col("o_orderpriority") == "5-LOW")
    target.commit(rows.where("o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"))
    return target


@query
def lake_table_merge(spark, sf):
    return _orders_table(spark, sf).read()


@query
def lake_table_time_travel(spark, sf):
    return _orders_table(spark, sf).read(version=2)


@query
def lake_table_changes(spark, sf):
    return _orders_table(spark, sf).changes(1, 3).drop("_commit_ts")


@query
def lake_table_compacted(spark, sf):
    """History folded in the middle of the log, and the newest version merged from what is left of it."""
    target = _orders_table(spark, sf)
    maintenance.fold(target, 3)
    maintenance.compact(target)
    return target.read(version=target.latest_version())


@query
def lake_partitioned_events(spark, sf):
    """Events copied into the day-partitioned layout with eight buckets and read back."""
    target = LakeTable(spark, TABLES["user_events_indexed"], scratch_dir(spark, "indexed")).create()
    target.commit(tables.user_events(spark, sf))
    return ntz_columns(target.read())


@query
def lake_bucketed_events(spark, sf):
    """Events hash-distributed on the user in ten buckets, counted per user from the copy.

    The count reads the files and not the table: partial sums that meet in a shuffle are not bound to
    ten tasks, of which one would have a hot user's bucket. So the table itself can go at once.
    """
    path = scratch_dir(spark, "bucketed")
    name = "bucketed_" + path.rsplit("-", 1)[-1]
    maintenance.write_bucketed(
        tables.user_events(spark, sf), name, "user_id", 10, ["user_id", "event_time"], path=path
    )
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path).groupBy("user_id").agg(
        F.count("*").alias("event_count"), F.max("event_time").alias("last_time")
    )


@query
def lake_bucketed_join(spark, sf):
    """Every event with its user's number of events: both sides are distributed on the user, and nothing is shuffled."""
    path = scratch_dir(spark, "bucketed")
    name = "bucketed_" + path.rsplit("-", 1)[-1]
    rows = tables.user_events(spark, sf).select("user_id", "event_type", "event_time")
    maintenance.write_bucketed(rows, name, "user_id", 10, ["user_id", "event_time"], path=path)
    copy = spark.table(name)
    totals = copy.groupBy("user_id").agg(F.count("*").alias("event_count"))
    return copy.join(totals.hint("merge"), "user_id")


@query
def backup_restored_events(spark, sf):
    path = scratch_dir(spark, "backup")
    maintenance.backup(tables.table(spark, sf, "events"), path)
    return maintenance.restore(spark, path)


# --- messages and staged load -----------------------------------------------------------------

def _event_messages(spark, sf):
    """Events as messages. Sign-ups use another name for the time, errors are cut short."""
    events = tables.user_events(spark, sf).drop("event_date")
    text = F.to_json(F.struct("user_id", "event_type", "event_time", F.col("properties")))
    return events.select(
        F.when(F.col("event_type") == "signup", F.replace(text, F.lit("event_time"), F.lit("timestamp")))
        .when(F.col("event_type") == "error", F.concat(F.lit("{"), text))
        .otherwise(text).alias("value")
    )


@query
def message_roundtrip(spark, sf):
    topic = TOPICS["user-behavior"]
    sent = messages.encode(tables.user_behavior(spark, sf))
    return ntz_columns(messages.good_rows(messages.decode(sent, topic.schema), topic.event_time))


@query
def message_dead_letters(spark, sf):
    topic = TOPICS["user-events"]
    decoded = messages.decode(_event_messages(spark, sf), topic.schema)
    bad = messages.dead_letters(decoded, topic.event_time)
    return bad.groupBy("reason").agg(F.count("*").alias("messages"))


@query
def staged_load_audit(spark, sf):
    topic = TOPICS["user-events"]
    return staged.run_stages(
        _event_messages(spark, sf), scratch_dir(spark, "staged"), topic.schema, topic.event_time,
        keys=["user_id", "event_type"], order_by=["event_time"],
    )


# --- streams: the whole events table through the streaming jobs ---------------------------------

# Micro-batches of each stream, one after the other in time, and files of each.
SLICES, SLICE_FILES = 5, 4


def _slice(spark, events) -> Column:
    """The fifth of the events' time in which an event lies."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return F.lit(0)
    bounds = [F.lit(str(first + (last - first) * k / SLICES)).cast("timestamp_ntz") for k in range(1, SLICES)]
    return sum((F.coalesce((F.col("ts") >= bound).cast("int"), F.lit(0)) for bound in bounds), F.lit(0))


def _feed(spark, rows, slice_: Column) -> str:
    """The rows as files below the scratch folder that appear slice after slice."""
    path = scratch_dir(spark, "feed")
    messages.write_slices(rows, slice_, path, SLICE_FILES)
    return path


def _event_feed(spark, sf) -> str:
    events = tables.table(spark, sf, "events")
    return _feed(spark, events, _slice(spark, events))


def _event_stream(spark, feed, time_column, lateness, rows_from):
    schema = spark.read.option("recursiveFileLookup", True).parquet(feed).schema
    events = spark.readStream.schema(schema).options(maxFilesPerTrigger=SLICE_FILES, recursiveFileLookup=True).parquet(feed)
    rows = rows_from(events).withColumn(time_column, F.col(time_column).cast("timestamp"))
    return rows.withWatermark(time_column, lateness)


def _behavior_stream(spark, feed):
    return _event_stream(spark, feed, "ts", "5 seconds", tables.behavior_from)


def _order_stream(spark, feed):
    return _event_stream(spark, feed, "order_time", "10 seconds", tables.orders_from)


def _new_table(spark, name) -> LakeTable:
    return LakeTable(spark, TABLES[name], scratch_dir(spark, name)).create()


def _filled_together(spark, **starts) -> list[LakeTable]:
    """The tables of streaming jobs, by name, that ran next to each other to the end of their input."""
    targets = [_new_table(spark, name) for name in starts]
    run_together(
        [partial(start, target, RunSettings(scratch_dir(spark, "progress"), interval=None))
         for start, target in zip(starts.values(), targets)],
        attempts=0, look_every=0.1)
    return targets


def _filled(spark, name, start) -> LakeTable:
    """The table of a streaming job that ran to the end of its input."""
    return _filled_together(spark, **{name: start})[0]


def _run(spark, name, start) -> DataFrame:
    """Run a streaming job to the end of its input and read its table."""
    return ntz_columns(chains.latest(_filled(spark, name, start)))


@query
def stream_user_behavior_summary(spark, sf):
    rows = _behavior_stream(spark, _event_feed(spark, sf))
    return _run(spark, "user_behavior_summary", lambda t, s: jobs.user_behavior_summary(rows, t, s))


@query
def stream_order_summary(spark, sf):
    rows = _order_stream(spark, _event_feed(spark, sf))
    return _run(spark, "order_summary", lambda t, s: jobs.order_summary(rows, t, s))


def _stats_job(spark, sf, feed):
    rows = _order_stream(spark, feed)
    return lambda t, s: jobs.product_sales_stats(rows, lambda session: tables.products(session, sf), t, s)


@query
def stream_product_sales_stats(spark, sf):
    return _run(spark, "product_sales_stats", _stats_job(spark, sf, _event_feed(spark, sf)))


@query
def stream_hourly_aggregations(spark, sf):
    feed = _event_feed(spark, sf)
    return _run(
        spark, "hourly_aggregations",
        lambda t, s: jobs.hourly_aggregations(_behavior_stream(spark, feed), _order_stream(spark, feed), t, s),
    )


@query
def stream_word_count(spark, sf):
    rows = _event_stream(spark, _event_feed(spark, sf), "ts", "5 seconds", tables.words_from)
    return _run(spark, "word_count", lambda t, s: jobs.word_count(rows, t, s))


@query
def stream_user_events_hourly(spark, sf):
    rows = _event_stream(spark, _event_feed(spark, sf), "event_time", "5 seconds", tables.user_events_from)
    counts = _run(spark, "user_event_counts", lambda t, s: jobs.user_event_counts(rows, t, s))
    return behavior.hourly_from_counts(counts)


@query
def stream_follow_table(spark, sf):
    """A copy that follows a table over several commits and expiries holds all of its rows."""
    events = tables.user_events(spark, sf)
    source, copy = _new_table(spark, "user_events_indexed"), _new_table(spark, "user_events_optimized")
    settings = RunSettings(scratch_dir(spark, "progress"), interval=None)

    def follow():
        added = source.follow().where(F.col("_op") == changelog.UPSERT).drop(*changelog.LOG_COLUMNS)
        upsert_stream(added, copy, settings, output_mode="append").awaitTermination()

    for k in range(SLICES):
        source.commit(events.where(F.coalesce(F.pmod("user_id", F.lit(SLICES)), F.lit(0)) == k))
        if k % 2:
            maintenance.expire_snapshots(source, datetime(2100, 1, 1, tzinfo=timezone.utc), keep_at_least=1)
            follow()
    follow()
    return ntz_columns(copy.read())


def _fates(spark, good, bad) -> DataFrame:
    fate = spark.read.parquet(good).select(F.lit("good").alias("fate")).unionAll(
        spark.read.parquet(bad).select(F.col("reason").alias("fate")))
    return fate.groupBy("fate").agg(F.count("*").alias("messages"))


@query
def stream_dead_letters(spark, sf):
    """What became of all messages sent: rows, or dead letters by reason, of the same micro-batches."""
    topic = TOPICS["user-events"]
    feed, good, bad, progress = (scratch_dir(spark, name) for name in ("messages", "good", "dead-letters", "progress"))
    _event_messages(spark, sf).repartition(SLICES * SLICE_FILES).write.text(feed)
    source = messages.read_folder(spark, feed, SLICE_FILES)
    jobs.take_in(source, topic, good, bad, RunSettings(progress, interval=None)).awaitTermination()
    return _fates(spark, good, bad)


@query
def stream_word_count_committed(spark, sf):
    """The word counts of the quarter days that are marked as finished, with their partition."""
    rows = _event_stream(spark, _event_feed(spark, sf), "ts", "5 seconds", tables.words_from)
    path, progress = scratch_dir(spark, "committed"), scratch_dir(spark, "progress")
    jobs.word_count_committed(rows, path, RunSettings(progress, interval=None), "6 hours", "1 minute").awaitTermination()
    return ntz_columns(partitions.read_finished(
        spark, path, "word string, count long, window_start timestamp, window_end timestamp"))


@query
def stream_windows_in_state(spark, sf):
    """The word windows that are still open after the last batch, with what is counted in them."""
    rows = _event_stream(spark, _event_feed(spark, sf), "ts", "2 days", tables.words_from)
    path, progress = scratch_dir(spark, "closed"), scratch_dir(spark, "progress")
    jobs.word_count_files(rows, path, RunSettings(progress, interval=None)).awaitTermination()
    found = state.windows_in_state(spark, progress)
    return ntz_columns(found.select("word", F.col("value.count").alias("count"), "window_start", "window_end"))


@query
def stream_distinct_users(spark, sf):
    """Distinct users per type and hour from the bitmaps that every micro-batch appends."""
    rows = _event_stream(spark, _event_feed(spark, sf), "event_time", "5 seconds", tables.user_events_from)
    path, progress = scratch_dir(spark, "user-bitmaps"), scratch_dir(spark, "progress")
    jobs.user_bitmaps(rows, path, RunSettings(progress, interval=None)).awaitTermination()
    return ntz_columns(behavior.distinct_users(spark.read.parquet(path), "hour"))


def _repeated_feed(spark, sf, late: Column, again: int) -> str:
    """Every event twice, the second time ``again`` slices later; late ones come a slice later both times."""
    events = tables.table(spark, sf, "events")
    slices = F.explode(F.array(*[_slice(spark, events) + late.cast("int") + k for k in (0, again)]))
    return _feed(spark, events.withColumn("arrives", slices), F.col("arrives"))


@query
def stream_without_repeats(spark, sf):
    """Events that come twice, in different batches, and some of them late, each once."""
    feed = _repeated_feed(spark, sf, F.col("event_id") % 10 == 0, 1)
    rows = _event_stream(spark, feed, "ts", "20 days", lambda events: events.drop("arrives"))
    path, progress = scratch_dir(spark, "once"), scratch_dir(spark, "progress")
    once = messages.without_repeats(rows, ["event_id"])
    jobs.append_once(once, path, RunSettings(progress, interval=None)).awaitTermination()
    return ntz_columns(spark.read.parquet(path).drop("batch"))


@query
def stream_metrics(spark, sf):
    """Rows in and rows that came too late, per micro-batch, from the progress of a query.

    A batch drops what the watermark of the batch before it has passed.
    """
    feed = _repeated_feed(spark, sf, F.lit(False), 2)
    rows = _event_stream(spark, feed, "ts", "1 hour", lambda events: events.select("event_id", "ts"))
    once = messages.without_repeats(rows, ["event_id"])
    query_ = started(once, once.writeStream.format("noop"), RunSettings(scratch_dir(spark, "progress"), interval=None))
    query_.awaitTermination()
    samples = metrics.samples(spark, metrics.of_query(query_))
    wide = samples.groupBy("ts").pivot("metric", ["batch_id", "rows_in", "late_rows"]).agg(F.max("value"))
    return wide.where("rows_in > 0").select(*[F.col(c).cast("bigint").alias(c) for c in ("batch_id", "rows_in", "late_rows")])


# --- chains: streams fill tables, jobs read them and fill others ---------------------------------

def _summary_tables(spark, feed, **others) -> list[LakeTable]:
    """Both summaries, and the tables of other jobs over the same feed."""
    seen, bought = _behavior_stream(spark, feed), _order_stream(spark, feed)
    return _filled_together(
        spark,
        user_behavior_summary=lambda t, s: jobs.user_behavior_summary(seen, t, s),
        order_summary=lambda t, s: jobs.order_summary(bought, t, s),
        **others,
    )


def _profile_table(spark, summary, bought) -> LakeTable:
    target = _new_table(spark, "user_profile")
    chains.user_profile(summary, bought, target, AS_OF, DAY)
    return target


@query
def chain_user_profile(spark, sf):
    return ntz_columns(chains.latest(_profile_table(spark, *_summary_tables(spark, _event_feed(spark, sf)))))


@query
def chain_recommendations(spark, sf):
    feed = _event_feed(spark, sf)
    *summaries, stats = _summary_tables(spark, feed, product_sales_stats=_stats_job(spark, sf, feed))
    target = _new_table(spark, "real_time_recommendations")
    chains.recommendations(_profile_table(spark, *summaries), stats, target, AS_OF, DAY, DAY)
    return ntz_columns(chains.latest(target))


@query
def chain_wide(spark, sf):
    target = _new_table(spark, "user_behavior_wide")
    settings = RunSettings(scratch_dir(spark, "progress"), interval=None)
    chains.user_behavior_wide(*_summary_tables(spark, _event_feed(spark, sf)), target, settings).awaitTermination()
    return ntz_columns(chains.latest(target))


@query
def chain_record_count(spark, sf):
    summary, bought = _summary_tables(spark, _event_feed(spark, sf))
    target = _new_table(spark, "dq_record_count")
    chains.dq_record_count({"user_behavior_summary": summary, "order_summary": bought}, target, AS_OF, DAY)
    return ntz_columns(chains.latest(target))


@query
def stream_ingest_events(spark, sf):
    feed = _event_feed(spark, sf)
    rows = _event_stream(spark, feed, "event_time", "5 seconds", tables.user_events_from).drop("event_date")
    path = scratch_dir(spark, "ingested")
    jobs.ingest_events(rows, path, RunSettings(scratch_dir(spark, "progress"), interval=None)).awaitTermination()
    return ntz_columns(spark.read.parquet(path))
