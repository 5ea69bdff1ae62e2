"""Reports over the sample rows, with results worked out by hand."""

from datetime import date, datetime
from decimal import Decimal

from conftest import rows_of
from tarnlake.plans import behavior, profile, quality, sales, words
from tarnlake.schemas import SALES_DATA, TABLES, USER_EVENTS
from tarnlake.sources import external

# The sample events, sales and the sample file.
EVENTS = [
    (1, "click", datetime(2024, 1, 1, 10, 0), '{"page": "/home", "source": "web"}'),
    (2, "purchase", datetime(2024, 1, 1, 10, 5), '{"product_id": "123", "amount": 99.99}'),
    (3, "view", datetime(2024, 1, 1, 10, 10), '{"page": "/product", "duration": 30}'),
    (4, "click", datetime(2024, 1, 1, 10, 15), '{"page": "/cart", "source": "mobile"}'),
    (5, "logout", datetime(2024, 1, 1, 10, 20), '{"session_duration": 1200}'),
]
SALES_FILE = """id,product_name,category,price,quantity,sale_date,region
1,Laptop,Electronics,999.99,2,2024-01-01,North
2,Phone,Electronics,599.99,5,2024-01-02,South
3,Book,Education,29.99,10,2024-01-03,East
4,Chair,Furniture,199.99,3,2024-01-04,West
5,Table,Furniture,299.99,1,2024-01-05,North
6,Monitor,Electronics,299.99,4,2024-01-06,South
7,Desk,Furniture,399.99,2,2024-01-07,East
8,Keyboard,Electronics,79.99,8,2024-01-08,West
9,Mouse,Electronics,49.99,12,2024-01-09,North
10,Notebook,Education,9.99,20,2024-01-10,South
"""


def events(spark):
    rows = external.literal_rows(spark, USER_EVENTS, EVENTS)
    return rows.selectExpr("*", "to_date(event_time) AS event_date")


def sales_file(spark, folder):
    with open(f"{folder}/sales.csv", "w") as file:
        file.write(SALES_FILE)
    return external.read_csv(spark, f"{folder}/sales.csv", SALES_DATA)


def test_sales_by_category_of_the_first_five(spark, folder):
    report = sales.sales_by_category(sales_file(spark, folder).where("id <= 5"))
    assert [tuple(r) for r in report.collect()] == [
        ("Electronics", 2, 7, Decimal("4999.93")),
        ("Furniture", 2, 4, Decimal("899.96")),
        ("Education", 1, 10, Decimal("299.90")),
    ]


def test_sales_of_last_days(spark, folder):
    report = sales.sales_of_last_days(sales_file(spark, folder), "2024-01-10 09:00:00", 2)
    assert [tuple(r) for r in report.collect()] == [
        ("Electronics", "West", 1, 8, Decimal("639.92"), Decimal("79.99")),
        ("Electronics", "North", 1, 12, Decimal("599.88"), Decimal("49.99")),
        ("Education", "South", 1, 20, Decimal("199.80"), Decimal("9.99")),
    ]


def test_csv_types(spark, folder):
    assert sales_file(spark, folder).schema == SALES_DATA
    assert sales_file(spark, folder).count() == 10


def test_events_of_day_are_ordered(spark):
    found = behavior.events_of_day(events(spark), "2024-01-01").collect()
    assert [r.user_id for r in found] == [1, 2, 3, 4, 5]
    assert behavior.events_of_day(events(spark), "2024-01-02").count() == 0


def test_payload_field(spark):
    pages = behavior.payload_field(events(spark), "page")
    assert [r.page for r in pages.orderBy("user_id").collect()] == ["/home", None, "/product", "/cart", None]


def test_completeness_counts_null_users_as_duplicates(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, "d")]
    df = spark.createDataFrame(rows, "user_id bigint, event_type string").selectExpr(
        "*", "DATE '2024-01-01' AS event_date")
    found = quality.dq_completeness(df, "2024-01-01 12:00:00").first()
    assert tuple(found) == ("user_events", date(2024, 1, 1), 4, 1, 2, Decimal("75.00"))
    empty = quality.dq_completeness(df, "2024-01-02 12:00:00").first()
    assert tuple(empty)[2:] == (0, 0, 0, Decimal("0.00"))


def test_alert_levels(spark):
    now = datetime(2024, 1, 1, 0, 1)
    for count, level in [(60_001, "HIGH"), (60_000, "MEDIUM"), (30_001, "MEDIUM"), (30_000, "LOW")]:
        df = spark.range(count).selectExpr("TIMESTAMP_NTZ '2024-01-01 00:00:30' AS ts")
        found = quality.system_monitoring(df, now).first()
        assert found.alert_level == level
        assert found.metric_value == (Decimal(count) / 60).quantize(Decimal("0.01"), "ROUND_HALF_UP")


def test_profile_keeps_the_most_frequent_behavior(spark):
    summary = spark.sql("""
        SELECT * FROM VALUES
        (1L, 'view', 3L, TIMESTAMP '2024-01-01 09:30:00', TIMESTAMP '2024-01-01 09:30:00'),
        (1L, 'click', 5L, TIMESTAMP '2024-01-01 09:40:00', TIMESTAMP '2024-01-01 09:40:00'),
        (1L, 'click', 9L, TIMESTAMP '2024-01-01 08:00:00', TIMESTAMP '2024-01-01 08:00:00'),
        (2L, 'view', 1L, TIMESTAMP '2024-01-01 09:45:00', TIMESTAMP '2024-01-01 09:45:00')
        AS t(user_id, behavior_type, behavior_count, last_behavior_time, window_start)""")
    order_rows = spark.sql("""
        SELECT 1L AS user_id, 2L AS total_orders, CAST(600.5 AS DECIMAL(15,2)) AS total_amount,
        TIMESTAMP '2024-01-01 09:50:00' AS last_order_time, TIMESTAMP '2024-01-01 09:50:00' AS window_start""")
    changes = profile.user_profile_changes(summary, order_rows, "2024-01-01 10:00:00")
    assert changes.count() == 3
    found = {r.user_id: r for r in profile.user_profile(changes).collect()}
    assert (found[1].favorite_category, found[1].total_behaviors, found[1].total_orders) == ("click", 5, 2)
    assert found[1].last_activity_time == datetime(2024, 1, 1, 9, 50)
    # No orders: the greatest of a time and NULL is NULL.
    assert found[2].last_activity_time is None and found[2].total_spent == Decimal("0.00")


def _stats(spark):
    return spark.range(15).selectExpr(
        "id AS product_id", "CAST((id % 7) * 10 AS DECIMAL(15,2)) AS total_revenue",
        "TIMESTAMP '2024-01-01 09:30:00' AS window_start")


def _profiles(spark):
    return spark.sql("""
        SELECT * FROM VALUES (1L, 1000.01BD, TIMESTAMP '2024-01-01 09:45:00'),
        (2L, 1000.00BD, TIMESTAMP '2024-01-01 09:30:00'), (3L, 500.00BD, TIMESTAMP '2024-01-01 09:59:00'),
        (4L, 9.00BD, TIMESTAMP '2024-01-01 09:29:59'), (5L, 9.00BD, CAST(NULL AS TIMESTAMP))
        AS t(user_id, total_spent, last_activity_time)""")


def test_recommendations(spark):
    found = profile.recommendations(_profiles(spark), _stats(spark), "2024-01-01 10:00:00")
    best = [6, 13, 5, 12, 4, 11, 3, 10, 2, 9]
    assert rows_of(found, "user_id", "recommendation_score") == [
        (1, Decimal("0.9000")), (2, Decimal("0.7000")), (3, Decimal("0.5000"))]
    assert all(r.recommended_products == best for r in found.collect())
    candidates = profile.recommendation_candidates(_profiles(spark), _stats(spark), "2024-01-01 10:00:00")
    assert candidates.count() == 30
    assert rows_of(candidates.where("user_id = 1").selectExpr("recommended_products[0]")) == [
        (p,) for p in sorted(best, key=lambda v: repr((v,)))]


def test_no_recent_product_gives_no_recommendation(spark):
    found = profile.recommendations(_profiles(spark), _stats(spark).where("false"), "2024-01-01 10:00:00")
    assert found.count() == 0


def test_text_word_count(spark):
    texts = spark.createDataFrame([("Été, the End! the_end",), ("THE end",), (None,)], "text string")
    ascii_words = {r.word: r["count"] for r in words.text_word_count(texts).collect()}
    assert ascii_words == {"t": 1, "the": 2, "end": 2, "the_end": 1}
    accented = {r.word: r["count"] for r in words.text_word_count(texts, pattern=words.UNICODE_WORDS).collect()}
    assert accented == {"été": 1, "the": 3, "end": 3}


def test_declared_tables_are_consistent():
    for spec in TABLES.values():
        own = set(spec.keys) | {c for c, text in spec.computed.items() if any(k in text for k in spec.keys)}
        if spec.keys:
            assert set(spec.partition_by) <= own, spec.name
