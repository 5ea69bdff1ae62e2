"""Jobs that read the tables other jobs write, and write tables of their own.

Each is one step, for a trigger to run: ``runner.on_each_trigger(spark, step, settings)``. The jobs with a
look-back read only its partitions of their tables; the wide table follows the commits of both
summaries, so a step costs what has changed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.functions.moments import AsOf
from tarnlake.lake.table import LakeTable
from tarnlake.plans import behavior, profile, quality
from tarnlake.streaming.runner import RunSettings, started


def user_profile(
    summary: LakeTable, orders: LakeTable, target: LakeTable, as_of: AsOf = None, look_back: str = "1 hour"
) -> int:
    """The profiles of the users seen in the look-back; older profiles stay."""
    changes = profile.user_profile_changes(summary.read(), orders.read(), as_of, look_back)
    return target.commit(profile.user_profile(changes))


def recommendations(
    profiles: LakeTable,
    stats: LakeTable,
    target: LakeTable,
    as_of: AsOf = None,
    look_back: str = "1 hour",
    active_within: str = "30 minutes",
) -> int:
    """The best products for the users active lately."""
    return target.commit(profile.recommendations(profiles.read(), stats.read(), as_of, look_back, active_within))


def user_behavior_wide(summary: LakeTable, orders: LakeTable, target: LakeTable, settings: RunSettings) -> StreamingQuery:
    """Behaviour windows with their orders, for the windows that changed on either side.

    The job follows the logs of both tables. A change names a user and a window; their rows are read as they are
    now, so changes that come late or twice do no harm.
    """
    keys = ["user_id", "window_start"]
    changed = summary.follow().select(*keys).unionByName(orders.follow().select(*keys))

    def write(batch: DataFrame, batch_id: int) -> None:
        touched = batch.distinct()
        rows = summary.read().join(touched, keys, "left_semi")
        target.commit(behavior.user_behavior_wide(rows, orders.read()))

    return started(changed, changed.writeStream.outputMode("append").foreachBatch(write), settings)


def dq_record_count(
    summaries: Mapping[str, LakeTable], target: LakeTable, as_of: AsOf = None, look_back: str = "1 hour"
) -> int:
    """How many rows each summary has in the look-back."""
    counts = quality.dq_record_count({name: table.read() for name, table in summaries.items()}, as_of, look_back)
    return target.commit(counts)


def system_monitoring(rows: DataFrame, target: LakeTable, as_of: AsOf = None, look_back: str = "1 minute") -> int:
    """Records a second over the look-back and its alert level; ``rows`` are behaviour rows with ``ts``."""
    return target.commit(quality.system_monitoring(rows, as_of, look_back))


def latest(table: LakeTable) -> DataFrame:
    """The declared columns of a table's present state."""
    return table.read().select(*[F.col(name) for name in table.spec.schema.names])
