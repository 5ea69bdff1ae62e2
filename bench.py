"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local threads. Every
query runs to its last row without keeping a result: once cold, then twice warm, of which the faster
run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnlake.registry import QUERIES  # noqa: E402
from tarnlake.session import build_session, scratch_dir  # noqa: E402
from tarnlake.sources import messages  # noqa: E402

HEADLINE = [
    "user_behavior_summary",
    "order_summary_bulk",
    "product_sales_stats_bulk",
    "user_profile_day",
    "recommendations_day",
    "user_behavior_wide",
    "hourly_aggregations_bulk",
    "sales_by_category",
    "user_events_hourly",
    "sales_of_last_days",
    "sales_summary",
    "purchase_sales",
    "text_word_count",
    "lake_current_state",
    "lake_latest_order_lines",
    "lake_table_merge",
    "metric_rate",
    "table_row_counts",
    "stream_user_behavior_summary",
]
# The load of the ingest benchmark.
INGEST_MESSAGES, INGEST_BYTES = 10_000, 1_000


def ingest(spark, sf_dir):
    """Write the benchmark load as message files and count it back."""
    path = scratch_dir(spark, "ingest")
    messages.click_messages(spark, INGEST_MESSAGES, per_second=1000, pad_to=INGEST_BYTES).write.text(path)
    return spark.read.text(path).groupBy().count()


def timed(spark, run, sf_dir) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cpus=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    runs = {name: QUERIES[name] for name in HEADLINE}
    runs["ingest_10000x1000"] = ingest
    cold, warm = {}, {}
    for name, run in runs.items():
        cold[name] = timed(spark, run, sf_dir)
        warm[name] = min(timed(spark, run, sf_dir) for _ in range(2))
    print(json.dumps({
        "metric": "headline queries, warm, total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
