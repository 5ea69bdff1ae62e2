"""The two monitoring dashboards as queries over metric samples."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tarnlake.functions import interval_seconds
from tarnlake.functions.moments import AsOf
from tarnlake.operators import timeseries


RATE_RANGE = "5 minutes"


@dataclass(frozen=True)
class Panel:
    """One expression of a dashboard: ``kind`` is latest, percent, rate or range; ``exporter`` says
    who exports its metrics."""

    exporter: str
    title: str
    kind: str
    metric: str
    legend: str = ""
    whole: str | None = None


# The expressions of the two dashboards. The metrics of the first come from two exporters,
# the manager of the jobs and their workers. Names are without the exporter's prefix; ``panel_query``
# takes the prefixes by exporter.
STREAM_PANELS = (
    Panel("manager", "Job Status Overview", "latest", "jobs_Status_Running", "Running Jobs"),
    Panel("manager", "Job Status Overview", "latest", "jobs_Status_Failed", "Failed Jobs"),
    Panel("manager", "Job Status Overview", "latest", "jobs_Status_Finished", "Finished Jobs"),
    Panel("worker", "Task Slots Usage", "percent", "Status_JVM_Memory_Heap_Used", "Memory Usage %",
          "Status_JVM_Memory_Heap_Max"),
    Panel("worker", "Records Processed", "rate", "job_task_operator_numRecordsIn", "Records In - {{job_name}}"),
    Panel("worker", "Records Processed", "rate", "job_task_operator_numRecordsOut", "Records Out - {{job_name}}"),
    Panel("manager", "Checkpoint Duration", "range", "job_lastCheckpointDuration",
          "Checkpoint Duration - {{job_name}}"),
    Panel("worker", "Backpressure Status", "range", "job_task_backPressuredTimeMsPerSecond",
          "Backpressure Time - {{job_name}}"),
    Panel("worker", "JVM Memory Usage", "range", "Status_JVM_Memory_Heap_Used", "Heap Used"),
    Panel("worker", "JVM Memory Usage", "range", "Status_JVM_Memory_Heap_Max", "Heap Max"),
    Panel("worker", "JVM Memory Usage", "range", "Status_JVM_Memory_NonHeap_Used", "NonHeap Used"),
    Panel("worker", "Task Manager Status", "latest", "Status_JVM_Memory_Heap_Used"),
)
LAKE_PANELS = (
    Panel("lake", "Tables Overview", "latest", "tables_total", "Total Tables"),
    Panel("lake", "Tables Overview", "latest", "tables_active", "Active Tables"),
    Panel("lake", "Tables Overview", "latest", "snapshots_total", "Total Snapshots"),
    Panel("lake", "Data Lake Storage Usage", "percent", "storage_used_bytes", "Storage Usage %",
          "storage_total_bytes"),
    Panel("lake", "Records Written per Second", "rate", "records_written_total",
          "Records Written - {{table_name}}"),
    Panel("lake", "File Operations", "rate", "files_created_total", "Files Created"),
    Panel("lake", "File Operations", "rate", "files_deleted_total", "Files Deleted"),
    Panel("lake", "File Operations", "rate", "files_compacted_total", "Files Compacted"),
    Panel("lake", "Snapshot Metrics", "range", "snapshots_created_total", "Snapshots Created - {{table_name}}"),
    Panel("lake", "Snapshot Metrics", "range", "snapshots_expired_total", "Snapshots Expired - {{table_name}}"),
    Panel("lake", "Compaction Metrics", "range", "compaction_duration_seconds",
          "Compaction Duration - {{table_name}}"),
    Panel("lake", "Compaction Metrics", "range", "compaction_files_input", "Input Files - {{table_name}}"),
    Panel("lake", "Compaction Metrics", "range", "compaction_files_output", "Output Files - {{table_name}}"),
    Panel("lake", "Table Sizes", "range", "table_size_bytes", "Table Size - {{table_name}}"),
    Panel("lake", "Table Details", "latest", "table_info"),
)


def panel_query(
    samples: DataFrame,
    panel: Panel,
    as_of: AsOf = None,
    look_back: str = "1 hour",
    prefixes: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(legend, labels, ts, value)`` of one panel expression; percentages also have a level."""
    prefix = (prefixes or {}).get(panel.exporter, "")
    metric = prefix + panel.metric
    if panel.kind == "latest":
        found = timeseries.latest_samples(samples, metric, as_of, look_back)
    elif panel.kind == "percent":
        both = samples.where(timeseries.since(samples, "ts", as_of, look_back))
        found = timeseries.with_threshold(timeseries.percent_of(both, metric, prefix + panel.whole))
    elif panel.kind == "rate":
        # The first rates of the look-back need the samples of one range before it.
        reach = f"{interval_seconds(look_back) + interval_seconds(RATE_RANGE)} seconds"
        found = timeseries.rate(samples.where(timeseries.since(samples, "ts", as_of, reach)), metric, RATE_RANGE)
        found = found.where(timeseries.since(found, "ts", as_of, look_back))
    else:
        found = timeseries.range_select(samples, metric, as_of, look_back)
    columns = ["labels", "ts", "value"] + (["level"] if panel.kind == "percent" else [])
    return found.select(timeseries.legend(panel.legend or panel.title).alias("legend"), *columns)
