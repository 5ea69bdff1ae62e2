"""Streams in: finished partitions, state, repeats, dead letters of the same batch, metrics of the streams."""

import os
import time

import pytest

from conftest import rows_of
from test_streaming import Feed, settings, topic_stream, word
from tarnlake.operators import timeseries
from tarnlake.schemas import TOPICS
from tarnlake.sources import messages
from tarnlake.streaming import jobs, metrics, partitions, runner, state
from tarnlake.streaming.runner import RunSettings, started

WORDS = "word string, count long, window_start timestamp, window_end timestamp"


def minutes(spark, path):
    return [name[-8:-3] for name in partitions.finished(spark, path)]


def test_only_finished_minutes_are_marked(spark, folder):
    """The watermark is five seconds behind; a minute is finished a minute after its end."""
    feed, out = Feed(folder), f"{folder}/out"
    run = lambda: jobs.word_count_committed(topic_stream(spark, feed, "word-count-input"), out, settings(folder)).awaitTermination()
    feed.add(word("00:00:30"), word("00:01:10", "b"))
    feed.add(word("00:02:04"))                     # 00:01:59: both windows are not yet past the delay
    run()
    assert minutes(spark, out) == [] and partitions.read_finished(spark, out, WORDS).count() == 0
    feed.add(word("00:02:05"), word("00:00:50"))   # 00:02:00 finishes the first minute; its late word is dropped
    run()
    assert minutes(spark, out) == ["00-00"]
    feed.add(word("00:09:00"))
    run()
    assert minutes(spark, out) == ["00-00", "00-01", "00-02"]
    assert rows_of(partitions.read_finished(spark, out, WORDS), "part", "word", "count") == [
        ("2024-01-01T00-00-00", "a", 1), ("2024-01-01T00-01-00", "b", 1), ("2024-01-01T00-02-00", "a", 2)]
    still = partitions.open_partitions(spark, out, max(int(n[6:]) for n in os.listdir(f"{out}/_open")))
    assert still.count() == 0
    run()
    assert minutes(spark, out) == ["00-00", "00-01", "00-02"]


@pytest.mark.parametrize("where", ["write_batch", "_mark"])
def test_partitions_after_a_failure(spark, folder, monkeypatch, where):
    """A batch that fails while it writes, or while it marks, is run again with the same watermark."""
    feed, out, failed = Feed(folder), f"{folder}/out", []
    for at in ("00:00:30", "00:01:10", "00:04:00", "00:09:00"):
        feed.add(word(at))
    real = getattr(partitions, where)

    def fails_once(*args):
        if not failed and (where == "_mark" or args[2] == 3):
            failed.append(args)
            real(*args)
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(partitions, where, fails_once)
    start = lambda: jobs.word_count_committed(topic_stream(spark, feed, "word-count-input"), out, settings(folder))
    runner.run_with_restarts(start, attempts=2, delay_seconds=0)
    assert failed and minutes(spark, out) == ["00-00", "00-01", "00-04"]
    assert rows_of(partitions.read_finished(spark, out, WORDS), "part", "count") == [
        ("2024-01-01T00-00-00", 1), ("2024-01-01T00-01-00", 1), ("2024-01-01T00-04-00", 1)]


def test_windows_in_state(spark, folder):
    feed, own = Feed(folder), settings(folder)
    feed.add(word("00:00:30"), word("00:00:40"), word("00:03:00", "b"))
    feed.add(word("00:03:30"))
    jobs.word_count_files(topic_stream(spark, feed, "word-count-input"), f"{folder}/out", own).awaitTermination()
    found = state.windows_in_state(spark, own.checkpoint)
    kept = found.selectExpr("word", "date_format(window_start, 'mm') AS minute", "value.count AS n")
    assert rows_of(kept) == [("a", "03", 1), ("b", "03", 1)]
    first = state.windows_in_state(spark, own.checkpoint, batch_id=0).selectExpr("word", "value.count AS n")
    assert rows_of(first) == [("a", 2), ("b", 1)]
    assert [r.operatorName for r in state.operators(spark, own.checkpoint).collect()] == ["stateStoreSave"]
    assert sum(r.state_rows for r in state.state_by_partition(spark, own.checkpoint).collect()) == 2


def event(at, user, number):
    return f'{{"user_id": {user}, "event_type": "click", "event_time": "2024-01-01T{at}.000Z", "properties": "{number}"}}'


def test_repeats_in_other_batches(spark, folder):
    feed = Feed(folder)
    feed.add(event("00:00:01", 1, 1), event("00:00:01", 1, 1), event("00:00:02", 2, 2))
    feed.add(event("00:00:03", 1, 3), event("00:00:01", 1, 1))
    feed.add(event("00:00:03", 9, 3), event("00:00:02", 2, 2))
    rows = messages.topic_rows(messages.read_folder(spark, feed.path, 1), TOPICS["user-events"])
    once = messages.without_repeats(rows, ["properties"])
    jobs.append_once(once, f"{folder}/once", settings(folder)).awaitTermination()
    assert [r[0] for r in rows_of(spark.read.parquet(f"{folder}/once"), "properties")] == ["1", "2", "3"]


@pytest.mark.parametrize("broken_side", ["good", "bad"])
def test_no_message_is_lost_between_good_and_dead(spark, folder, monkeypatch, broken_side):
    """After a failure between the two sides, and a restart, each message is on exactly one of them."""
    feed, failed = Feed(folder), []
    lines = [event(f"00:10:{n:02d}", n, n) if n % 3 else f"broken {n}" if n % 2 else f'{{"user_id": {n}}}' for n in range(30)]
    for n in range(0, 30, 6):
        feed.add(*lines[n:n + 6])
    real = jobs.write_batch

    def fails_once(batch, path, batch_id, *more):
        if batch_id == 2 and path.endswith(broken_side) and not failed:
            failed.append(path)
            raise RuntimeError("lost")
        real(batch, path, batch_id, *more)

    monkeypatch.setattr(jobs, "write_batch", fails_once)
    good, bad, topic = f"{folder}/good", f"{folder}/bad", TOPICS["user-events"]
    start = lambda: jobs.take_in(messages.read_folder(spark, feed.path, 1), topic, good, bad, settings(folder))
    runner.run_with_restarts(start, attempts=2, delay_seconds=0)
    feed.add("broken later", event("00:20:00", 99, 99))
    start().awaitTermination()
    assert failed
    kept = spark.read.parquet(good)
    assert sorted(r.user_id for r in kept.collect()) == [n for n in range(30) if n % 3] + [99]
    assert sorted(r.value for r in spark.read.parquet(bad).collect()) == sorted([lines[n] for n in range(0, 30, 3)] + ["broken later"])
    follow = messages.taken_in(spark, good, topic)
    query = started(follow, follow.writeStream.format("noop"), settings(folder, "follower"))
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 21


def test_progress_as_samples(spark, folder):
    feed, log = Feed(folder), f"{folder}/metrics"
    feed.add(word("00:00:30"), word("00:03:00"))
    feed.add(word("00:03:30"))
    feed.add(word("00:00:20"), word("00:05:00"))   # the first one is too late
    listener = metrics.ProgressLog(spark, log, every=2)
    spark.streams.addListener(listener)
    try:
        rows = topic_stream(spark, feed, "word-count-input")
        query = jobs.word_count_files(rows, f"{folder}/out", RunSettings(f"{folder}/p", None, "words"))
        query.awaitTermination()
        samples = metrics.samples(spark, metrics.of_query(query))
        totals = {r.metric: r.total for r in samples.groupBy("metric").agg({"value": "sum"}).toDF("metric", "total").collect()}
        assert totals["late_rows"] == 1 and totals["rows_in"] >= 5
        assert {r.job for r in samples.selectExpr("labels['job_name'] AS job").collect()} == {"words"}
        latest = timeseries.latest_samples(samples, "state_rows").first()
        assert latest["labels"]["operator"] == "0-stateStoreSave"
        for _ in range(50):  # progress reaches listeners some time after the batch
            listener.flush()
            if os.path.exists(log) and spark.read.parquet(log).where("metric = 'batch_id'").count() >= 3:
                break
            time.sleep(0.2)
        assert spark.read.parquet(log).where("metric = 'rows_in'").agg({"value": "sum"}).first()[0] == totals["rows_in"]
    finally:
        spark.streams.removeListener(listener)


def test_slices_are_read_in_order(spark, folder):
    rows = spark.range(40).selectExpr("id", "39 - id AS other")
    messages.write_slices(rows, rows.id % 4, f"{folder}/feed", 3)
    stream = spark.readStream.schema("id long, other long").options(maxFilesPerTrigger=3, recursiveFileLookup=True).parquet(f"{folder}/feed")
    seen = []
    query = started(stream, stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r.id % 4 for r in batch.collect()))), settings(folder))
    query.awaitTermination()
    assert seen == [[k] * 10 for k in range(4)]


def test_queries_run_together_are_restarted_each(spark, folder):
    """One of two queries fails once and goes on from its checkpoint; one that always fails ends both."""
    feeds = []
    for name in "ab":
        os.makedirs(f"{folder}/{name}")
        feeds.append(Feed(f"{folder}/{name}"))
        feeds[-1].add(word("00:00:01"))
        feeds[-1].add(word("00:00:02"))
    failed, seen = [], {"a": 0, "b": 0}

    def start(name, feed, always=False):
        def take(batch, number):
            if always or (name == "b" and number == 1 and not failed):
                failed.append(number)
                raise RuntimeError("lost")
            seen[name] += batch.count()
        rows = messages.read_folder(spark, feed.path, 1)
        return started(rows, rows.writeStream.foreachBatch(take), settings(folder, f"progress-{name}{always}"))

    runner.run_together([lambda: start("a", feeds[0]), lambda: start("b", feeds[1])], 1, 0, 0.1)
    assert seen == {"a": 2, "b": 2} and failed == [1]
    with pytest.raises(Exception, match="lost"):
        runner.run_together([lambda: start("a", feeds[0]), lambda: start("b", feeds[1], True)], 1, 0, 0.1)
