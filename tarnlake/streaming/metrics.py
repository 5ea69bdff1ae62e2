"""The progress of streaming queries as metric samples, for the operators over time series.

A sample is (metric, labels, ts, value). Labels are the query's name or id and, for state, the operator. The times
are the start of the trigger, so the samples of a query form one series per metric.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SAMPLES = "metric string, labels map<string,string>, ts timestamp, value double"

Sample = tuple[str, dict[str, str], datetime, float]


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def samples_of(progress: Mapping) -> list[Sample]:
    """The samples of one finished trigger."""
    at, job = _moment(progress["timestamp"]), {"job_name": progress.get("name") or progress["id"]}
    duration = progress.get("durationMs") or {}
    found: list[tuple[str, dict[str, str], float]] = [
        ("batch_id", job, progress["batchId"]),
        ("rows_in", job, progress["numInputRows"]),
        ("trigger_ms", job, duration.get("triggerExecution", 0)),
    ]
    watermark = (progress.get("eventTime") or {}).get("watermark")
    if watermark is not None:
        found.append(("watermark_seconds", job, _moment(watermark).timestamp()))
    for number, state in enumerate(progress.get("stateOperators") or []):
        labels = job | {"operator": f"{number}-{state['operatorName']}"}
        found += [
            ("state_rows", labels, state["numRowsTotal"]),
            ("state_bytes", labels, state["memoryUsedBytes"]),
            ("late_rows", labels, state["numRowsDroppedByWatermark"]),
        ]
    return [(metric, labels, at, float(value)) for metric, labels, value in found]


def samples(spark: SparkSession, progresses: Iterable[Mapping]) -> DataFrame:
    """The samples of the given triggers; of a query, ``recentProgress`` has those that it still remembers."""
    return spark.createDataFrame([s for progress in progresses for s in samples_of(progress)], SAMPLES)


def of_query(query: StreamingQuery) -> list[Mapping]:
    """The remembered progress of a query as plain maps."""
    import json

    return [json.loads(progress.json) if hasattr(progress, "json") else dict(progress) for progress in query.recentProgress]


class ProgressLog(StreamingQueryListener):
    """Appends the samples of all queries of a session to a folder, some triggers at a time.

    The folder is Parquet that the time-series operators and reports read like any other samples. Call
    ``flush`` before the session ends; ``spark.streams.addListener`` starts it.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self.held: list[Mapping] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        import json

        self.held.append(json.loads(event.progress.json))
        if len(self.held) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        held, self.held = self.held, []
        if held:
            samples(self.spark, held).coalesce(1).write.mode("append").parquet(self.path)
