"""Jobs to submit: ``spark-submit … tarnlake/__main__.py`` or ``python -m tarnlake <command> …``.

    word-count <texts> <output>
    stream <job> <table folder> <progress folder> (--servers HOST:PORT | --folder PATH) [--once]
           [--max-per-trigger N] [--dead-letters PATH] [--products PATH] [--compact-every N]
    files  <job> <output folder> <progress folder> (--servers HOST:PORT | --folder PATH) [--once] …
    chain  <job> <warehouse folder> <progress folder> [--as-of MOMENT] [--look-back "1 hour"] [--once]
    compact <table name> <table folder> [--if-needed]
    expire <table name> <table folder> [--days N] [--keep N] [--at-most N]
    retention <warehouse folder> [--as-of MOMENT]

A folder of messages holds the files of a job's topic, or one folder per topic for a job with several.
``--max-per-trigger`` paces a job: messages of a micro-batch with --servers, files with --folder.

Messages are first taken in: usable rows and dead letters of a micro-batch are written by one query, below
``<progress folder>-messages`` and, if given, the folder of ``--dead-letters``. The job reads the usable rows.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tarnlake.functions import interval_seconds
from tarnlake.lake import LakeTable, folders, maintenance
from tarnlake.plans import orders, words
from tarnlake.schemas import TABLES, TOPICS
from tarnlake.session import build_session, drop_scratch
from tarnlake.sources import messages
from tarnlake.streaming import chains, jobs
from tarnlake.streaming.runner import INTERVAL, MINI_BATCH_ROWS, RunSettings, on_each_trigger, run_together, run_with_restarts

# Streaming jobs with one topic and one table of the same name as the job.
STREAMS = {
    "user_behavior_summary": ("user-behavior", jobs.user_behavior_summary),
    "order_summary": ("orders", jobs.order_summary),
    "word_count": ("word-count-input", jobs.word_count),
    "user_events_hourly": ("user-events", jobs.user_events_hourly),
    "user_events": ("user-events", jobs.ingest_events_table),
}
# Jobs with more than one input, and those that write folders of files.
OTHER_STREAMS = ("product_sales_stats", "hourly_aggregations")
FILES = {
    "word_count_files": ("word-count-input", jobs.word_count_files),
    "behavior_windows": ("user-events", jobs.behavior_windows),
    "hourly_sales_trend": ("sales-data", jobs.hourly_sales_trend),
    "sales_data": ("sales-data", lambda rows, path, settings: jobs.ingest_sales(rows.drop("sale_timestamp"), path, settings)),
    "events_by_day": ("user-events", jobs.ingest_events),
}
CHAINS = ("user_profile", "real_time_recommendations", "user_behavior_wide", "dq_record_count", "system_monitoring")


def _source(spark: SparkSession, args: argparse.Namespace, topic: str, several: bool = False) -> DataFrame:
    if args.servers:
        most = args.max_per_trigger or MINI_BATCH_ROWS * interval_seconds(INTERVAL)
        return messages.read_kafka(spark, TOPICS[topic], args.servers, max_per_trigger=most)
    return messages.read_folder(spark, f"{args.folder}/{topic}" if several else args.folder, args.max_per_trigger)


def _good(args: argparse.Namespace, topic: str) -> str:
    return f"{args.progress}-messages/good/{topic}"


def _rows(spark: SparkSession, args: argparse.Namespace, topic: str) -> DataFrame:
    return messages.taken_in(spark, _good(args, topic), TOPICS[topic])


def _table(spark: SparkSession, name: str, path: str) -> LakeTable:
    return LakeTable(spark, TABLES[name], path).create()


def _settings(args: argparse.Namespace) -> RunSettings:
    interval = None if args.once else INTERVAL
    return RunSettings(args.progress, interval, args.job, getattr(args, "compact_every", None))


def _with_intake(spark: SparkSession, args: argparse.Namespace, topics: list[str], start: Callable) -> None:
    """Run a job behind the queries that take in its topics, all of which are started again after a failure."""
    settings, root = _settings(args), f"{args.progress}-messages"

    def intake(topic: str) -> Callable:
        own = RunSettings(f"{root}/progress/{topic}", settings.interval)
        bad = f"{args.dead_letters or root + '/dead'}/{topic}"
        folders.make(spark, _good(args, topic))
        return lambda: jobs.take_in(
            _source(spark, args, topic, len(topics) > 1), TOPICS[topic], _good(args, topic), bad, own)

    starts = [*[intake(topic) for topic in topics], lambda: start(settings)]
    if args.once:
        for each in starts:
            run_with_restarts(each)
    else:
        run_together(starts)


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    target = _table(spark, args.job, args.table)
    if args.job in STREAMS:
        topic, job = STREAMS[args.job]
        _with_intake(spark, args, [topic], lambda s: job(_rows(spark, args, topic), target, s))
    elif args.job == "hourly_aggregations":
        both = ["user-behavior", "orders"]
        _with_intake(spark, args, both, lambda s: jobs.hourly_aggregations(
            *[_rows(spark, args, topic) for topic in both], target, s))
    else:
        schema = TOPICS["products"].schema

        def products(session: SparkSession) -> DataFrame:
            updates = messages.good_rows(messages.decode(session.read.text(args.products), schema), "update_time")
            return orders.latest_products(updates)

        _with_intake(spark, args, ["orders"], lambda s: jobs.product_sales_stats(
            _rows(spark, args, "orders"), products, target, s))


def _chain(spark: SparkSession, args: argparse.Namespace) -> None:
    def table(name: str) -> LakeTable:
        return _table(spark, name, f"{args.warehouse}/{name}")

    target, summary = table(args.job), table("user_behavior_summary")
    when = {"as_of": args.as_of, "look_back": args.look_back}
    if args.job == "user_behavior_wide":
        run_with_restarts(lambda: chains.user_behavior_wide(summary, table("order_summary"), target, _settings(args)))
        return
    steps = {
        "user_profile": lambda: chains.user_profile(summary, table("order_summary"), target, **when),
        "real_time_recommendations": lambda: chains.recommendations(
            table("user_profile"), table("product_sales_stats"), target, **when),
        "dq_record_count": lambda: chains.dq_record_count(
            {"user_behavior_summary": summary, "order_summary": table("order_summary")}, target, **when),
        "system_monitoring": lambda: chains.system_monitoring(
            table("user_events").read().withColumnRenamed("event_time", "ts"), target, **when),
    }
    query = on_each_trigger(spark, steps[args.job], _settings(args))
    if query is not None:
        query.awaitTermination()


def _retention(spark: SparkSession, args: argparse.Namespace) -> None:
    names = [path.rsplit("/", 1)[1] for path in folders.matching(spark, f"{args.warehouse}/*")]
    tables = {n: _table(spark, n, f"{args.warehouse}/{n}") for n in names if n in TABLES}
    maintenance.apply_retention(tables["data_cleanup_config"], tables, args.as_of)


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tarnlake")
    commands = parser.add_subparsers(dest="command", required=True)

    count = commands.add_parser("word-count")
    count.add_argument("texts")
    count.add_argument("output")

    for name, names, place in (("stream", [*STREAMS, *OTHER_STREAMS], "table"), ("files", FILES, "output")):
        command = commands.add_parser(name)
        command.add_argument("job", choices=sorted(names))
        command.add_argument(place)
        command.add_argument("progress")
        source = command.add_mutually_exclusive_group(required=True)
        source.add_argument("--servers")
        source.add_argument("--folder")
        command.add_argument("--once", action="store_true")
        command.add_argument("--max-per-trigger", type=int)
        command.add_argument("--dead-letters")
        if name == "stream":
            command.add_argument("--products", help="folder of product messages, for product_sales_stats")
            command.add_argument("--compact-every", type=int)

    chain = commands.add_parser("chain")
    chain.add_argument("job", choices=sorted(CHAINS))
    chain.add_argument("warehouse")
    chain.add_argument("progress")
    chain.add_argument("--look-back", default="1 hour")
    chain.add_argument("--once", action="store_true")

    for name in ("compact", "expire"):
        command = commands.add_parser(name)
        command.add_argument("name", choices=sorted(TABLES))
        command.add_argument("table")
        if name == "compact":
            command.add_argument("--if-needed", action="store_true")
        else:
            command.add_argument("--days", type=int, default=maintenance.EXPIRE_AFTER.days)
            command.add_argument("--keep", type=int, default=maintenance.KEEP_AT_LEAST)
            command.add_argument("--at-most", type=int)

    retention = commands.add_parser("retention")
    retention.add_argument("warehouse")
    for command in (chain, retention):
        command.add_argument("--as-of")
    args = parser.parse_args(given)
    if args.command == "stream" and args.job == "product_sales_stats" and not args.products:
        parser.error("product_sales_stats needs --products")
    return args


def main(given: list[str] | None = None) -> None:
    args = _arguments(given)
    spark = build_session()
    try:
        _run(spark, args)
    finally:
        drop_scratch(spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "word-count":
        texts = spark.read.text(args.texts)
        words.text_word_count(texts, "value").write.mode("overwrite").parquet(args.output)
    elif args.command == "stream":
        _stream(spark, args)
    elif args.command == "files":
        topic, job = FILES[args.job]
        _with_intake(spark, args, [topic], lambda s: job(_rows(spark, args, topic), args.output, s))
    elif args.command == "chain":
        _chain(spark, args)
    elif args.command == "retention":
        _retention(spark, args)
    elif args.command == "compact":
        target = _table(spark, args.name, args.table)
        maintenance.compact_if_needed(target) if args.if_needed else maintenance.compact(target)
    else:
        maintenance.expire_snapshots(
            _table(spark, args.name, args.table), datetime.now(timezone.utc),
            timedelta(days=args.days), args.keep, args.at_most,
        )


if __name__ == "__main__":
    main()
