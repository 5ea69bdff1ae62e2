"""Declared schemas: message topics, keyed tables and their properties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_LONG, _INT, _TEXT, _FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_DAY, _TIME = T.DateType(), T.TimestampType()


def _money(precision: int, scale: int = 2) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


@dataclass(frozen=True)
class Topic:
    """A stream of JSON messages with an event time and its allowed lateness."""

    name: str
    group_id: str
    schema: T.StructType
    event_time: str
    lateness: str


@dataclass(frozen=True)
class TableSpec:
    """A lake table.

    ``keys`` empty means an append table. ``computed`` adds columns by SQL expression before a
    write. ``partition_by`` names key columns or columns computed from keys only: a change of a row
    then always lands in the partition of the row it replaces, and filters on the partition can be
    applied before the merge. ``order_by`` decides, within one commit, which row of a key is last.
    ``time_column`` is what a retention looks at in a table without a date partition.
    """

    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    computed: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    bucket_by: str | None = None
    buckets: int = 4
    target_file_size: str = "64MB"
    time_column: str | None = None

    def __post_init__(self) -> None:
        known = set(self.schema.names) | set(self.computed)
        single = [c for c in (self.bucket_by, self.time_column) if c]
        for column in (*self.keys, *self.partition_by, *self.order_by, *single):
            if column not in known:
                raise ValueError(f"table {self.name}: no column {column}")


USER_BEHAVIOR = _schema(user_id=_LONG, item_id=_LONG, category_id=_LONG, behavior=_TEXT, ts=_TIME)
ORDERS = _schema(order_id=_LONG, user_id=_LONG, product_id=_LONG, quantity=_INT,
                 price=_money(10), order_time=_TIME)
PRODUCTS = _schema(product_id=_LONG, product_name=_TEXT, category=_TEXT, price=_money(10),
                   update_time=_TIME)
USER_EVENTS = _schema(user_id=_LONG, event_type=_TEXT, event_time=_TIME, properties=_TEXT)
SALES_DATA = _schema(id=_LONG, product_name=_TEXT, category=_TEXT, price=_money(10), quantity=_INT,
                     sale_date=_DAY, region=_TEXT)
WORDS = _schema(word=_TEXT, count=_LONG, ts=_TIME)

# Topic names, consumer groups and allowed lateness.
TOPICS = {
    "user-behavior": Topic("user-behavior", "user-behavior-group", USER_BEHAVIOR, "ts", "5 seconds"),
    "orders": Topic("orders", "orders-group", ORDERS, "order_time", "10 seconds"),
    "products": Topic("products", "products-group", PRODUCTS, "update_time", "5 seconds"),
    "user-events": Topic("user-events", "user-events-group", USER_EVENTS, "event_time", "5 seconds"),
    "sales-data": Topic("sales-data", "sales-group", SALES_DATA, "sale_date", "1 day"),
    "word-count-input": Topic("word-count-input", "word-count-group", WORDS, "ts", "5 seconds"),
}

_WINDOW_DATE = {"window_date": "to_date(window_start)"}

# Windowed tables are partitioned by the day of the window: one folder per five-minute window would
# leave a small file per window and folder.
TABLES = {
    spec.name: spec
    for spec in [
        TableSpec("user_events", USER_EVENTS, ("user_id", "event_time"),
                  {"event_date": "to_date(event_time)"}, ("event_date",), bucket_by="user_id"),
        TableSpec("sales_data",
                  SALES_DATA, ("id", "sale_date"),
                  {"sale_timestamp": "cast(sale_date AS timestamp)"}, ("sale_date",), bucket_by="id"),
        TableSpec("word_count",
                  _schema(word=_TEXT, count=_LONG, window_start=_TIME, window_end=_TIME),
                  ("word", "window_start"), _WINDOW_DATE, ("window_date",), bucket_by="word"),
        TableSpec("user_behavior_summary",
                  _schema(user_id=_LONG, behavior_type=_TEXT, behavior_count=_LONG,
                          first_behavior_time=_TIME, last_behavior_time=_TIME,
                          window_start=_TIME, window_end=_TIME),
                  ("user_id", "behavior_type", "window_start"), _WINDOW_DATE, ("window_date",),
                  ("last_behavior_time",), "user_id"),
        TableSpec("order_summary",
                  _schema(user_id=_LONG, total_orders=_LONG, total_amount=_money(15),
                          avg_order_value=_money(10), first_order_time=_TIME, last_order_time=_TIME,
                          window_start=_TIME, window_end=_TIME),
                  ("user_id", "window_start"), _WINDOW_DATE, ("window_date",),
                  ("last_order_time",), "user_id"),
        TableSpec("product_sales_stats",
                  _schema(product_id=_LONG, product_name=_TEXT, category=_TEXT, total_sales=_LONG,
                          total_revenue=_money(15), avg_price=_money(10),
                          window_start=_TIME, window_end=_TIME),
                  ("product_id", "window_start"), _WINDOW_DATE, ("window_date",),
                  bucket_by="product_id"),
        TableSpec("user_profile",
                  _schema(user_id=_LONG, total_behaviors=_LONG, total_orders=_LONG,
                          total_spent=_money(15), favorite_category=_TEXT,
                          last_activity_time=_TIME, update_time=_TIME),
                  ("user_id",), order_by=("total_behaviors", "last_activity_time"),
                  bucket_by="user_id", time_column="update_time"),
        TableSpec("real_time_recommendations",
                  _schema(user_id=_LONG, recommended_products=T.ArrayType(_LONG),
                          recommendation_score=_money(5, 4), recommendation_time=_TIME),
                  ("user_id",), order_by=("recommendation_time",), bucket_by="user_id",
                  time_column="recommendation_time"),
        TableSpec("dq_record_count",
                  _schema(table_name=_TEXT, metric_type=_TEXT, metric_value=_LONG,
                          quality_score=_money(5), check_time=_TIME),
                  ("table_name", "metric_type", "check_time"),
                  {"check_date": "to_date(check_time)"}, ("check_date",), bucket_by="table_name"),
        TableSpec("dq_completeness",
                  _schema(table_name=_TEXT, metric_date=_DAY, record_count=_LONG, null_count=_LONG,
                          duplicate_count=_LONG, data_quality_score=_money(5)),
                  ("table_name", "metric_date"), {}, ("metric_date",), bucket_by="table_name"),
        TableSpec("user_behavior_wide",
                  _schema(user_id=_LONG, behavior_type=_TEXT, behavior_count=_LONG,
                          order_count=_LONG, total_spent=_money(15), behavior_time=_TIME,
                          order_time=_TIME, window_start=_TIME),
                  ("user_id", "behavior_type", "window_start"), _WINDOW_DATE, ("window_date",),
                  ("behavior_time",), "user_id", 8, "32MB"),
        TableSpec("hourly_aggregations",
                  _schema(aggregation_type=_TEXT, aggregation_key=_TEXT, aggregation_value=_LONG,
                          aggregation_time=_TIME),
                  ("aggregation_type", "aggregation_key", "aggregation_time"),
                  {"aggregation_date": "to_date(aggregation_time)"}, ("aggregation_date",),
                  bucket_by="aggregation_type"),
        TableSpec("data_cleanup_config",
                  _schema(table_name=_TEXT, retention_days=_INT, cleanup_enabled=_FLAG,
                          last_cleanup_time=_TIME),
                  ("table_name",), order_by=("last_cleanup_time",), bucket_by="table_name"),
        TableSpec("system_monitoring",
                  _schema(metric_name=_TEXT, metric_value=_money(10), metric_unit=_TEXT,
                          alert_threshold=_money(10), alert_level=_TEXT, check_time=_TIME),
                  ("metric_name", "check_time"), {"check_date": "to_date(check_time)"},
                  ("check_date",), bucket_by="metric_name"),
        TableSpec("user_events_hourly",
                  _schema(event_type=_TEXT, event_hour=_TIME, user_count=_LONG, event_count=_LONG),
                  ("event_type", "event_hour"), {"event_date": "to_date(event_hour)"},
                  ("event_date",), bucket_by="event_type"),
        TableSpec("user_event_counts",
                  _schema(event_type=_TEXT, user_id=_LONG, event_hour=_TIME, event_count=_LONG),
                  ("event_type", "user_id", "event_hour"), {"event_date": "to_date(event_hour)"},
                  ("event_date",), bucket_by="user_id"),
        TableSpec("sales_summary",
                  _schema(category=_TEXT, region=_TEXT, sale_date=_DAY, total_revenue=_money(15),
                          total_quantity=_LONG, order_count=_LONG, avg_price=_money(10)),
                  ("category", "region", "sale_date"), {}, ("sale_date",), bucket_by="category"),
        TableSpec("user_events_indexed", USER_EVENTS, (), {"event_date": "to_date(event_time)"},
                  ("event_date",), bucket_by="user_id", buckets=8),
        TableSpec("user_events_optimized", USER_EVENTS, (), {"event_date": "to_date(event_time)"},
                  ("event_date",), bucket_by="user_id", buckets=8),
        TableSpec("optimized_table", _schema(id=_LONG, data=_TEXT, ts=_TIME), (),
                  {"ts_date": "to_date(ts)"}, ("ts_date",), bucket_by="id", buckets=8),
        TableSpec("table_metrics",
                  _schema(table_name=_TEXT, metric_time=_TIME, metric_type=_TEXT, metric_value=_LONG),
                  ("table_name", "metric_time", "metric_type"),
                  {"metric_date": "to_date(metric_time)"}, ("metric_date",), bucket_by="table_name"),
    ]
}
