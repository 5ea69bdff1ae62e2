"""A lake table: a change log that Spark appends to and, for keyed tables, the present rows next to it.

Layout below the table folder::

    log/_commit_version=7/_commit_ms=1704067200000/<partition>=.../*.parquet   the changes of a version
    state/<partition>=.../*.parquet                                             the last change of every key

A commit writes its log folder and then merges the partitions that it touches: their rows and the changes, the last row of
every key, written with Spark's dynamic partition overwrite. So reading a table is a plain scan, whose filters
on partitions prune folders, and the cost of a commit grows with the partitions it touches. What the table was, and what changed, are filters
over the log (``changelog``).

One job at a time writes a table. A stream gives each batch a name: a batch that runs again replaces its own log folder, and
its partitions are merged from the log anew, whatever the failed attempt has left of them. Another job that failed
halfway is run again, or ``rebuild`` merges the table from its log. An append table has no keys; its rows are those of the log.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.moments import AsOf
from tarnlake.lake import changelog, folders
from tarnlake.schemas import TableSpec
from tarnlake.session import session_conf

_BUCKET = "_bucket"


def brought_together(
    rows: DataFrame, partition_by: Sequence[str], bucket_by: str | None, buckets: int
) -> DataFrame:
    """Rows of a partition and bucket in one task, as far as they fit into one file."""
    if bucket_by:
        rows = rows.withColumn("_bucket_of", F.pmod(F.hash(bucket_by), F.lit(buckets)))
        return rows.hint("rebalance", *partition_by, "_bucket_of").drop("_bucket_of")
    return rows.hint("rebalance", *partition_by)


def write_options(target_file_size: str, spread: bool = False) -> dict[str, str]:
    """Session options of a write.

    Rebalanced files come out at about the target size, also when that leaves cores without a task; with ``spread``
    every core gets one, but no partition and bucket is divided below that size.
    Timestamps are written as microseconds: the old default has no minimum and maximum per row
    group, so that filters on time could not skip any.
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": target_file_size,
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": str(spread).lower(),
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    }


class LakeTable:
    """Commits, reads and change reads of one table."""

    def __init__(self, spark: SparkSession, spec: TableSpec, path: str):
        self.spark = spark
        self.spec = spec
        self.path = path.rstrip("/")
        self.log_path, self.state_path = f"{self.path}/log", f"{self.path}/state"
        # A keyed table without partitions is merged by hash buckets.
        self.parts: tuple[str, ...] = spec.partition_by or (_BUCKET,)

    def create(self) -> LakeTable:
        folders.make(self.spark, self.path)
        return self

    # --- versions -----------------------------------------------------------------------------

    def versions(self) -> dict[int, int]:
        """The kept versions and their commit times in milliseconds, from one listing of names."""
        found = folders.matching(self.spark, f"{self.log_path}/_commit_version=*/_commit_ms=*")
        times = [(int(folders.value_of(p, "_commit_version")), int(folders.value_of(p, "_commit_ms"))) for p in found]
        return dict(sorted(times))

    def latest_version(self) -> int:
        """The newest committed version; 0 for an empty table."""
        return max(self.versions(), default=0)

    def version_of_batch(self, batch: str) -> int | None:
        """The version that a batch of this name was committed as, if it had rows."""
        if not self.versions():
            return None
        return self._raw_log().where(F.col("_batch") == batch).agg(F.max("_commit_version")).first()[0]

    def _kept(self, version: int, versions: dict[int, int]) -> None:
        """The first version that is kept holds all rows before it; without older ones, only from there on is history known."""
        first = min(versions, default=1)
        if first > 1 and version < first:
            raise ValueError(f"table {self.spec.name} no longer keeps version {version}")

    def version_at(self, as_of: AsOf) -> int:
        """The newest version committed at or before a moment (UTC); 0 if there was none yet."""
        moment = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        versions = self.versions()
        past = [number for number, millis in versions.items() if millis <= moment.timestamp() * 1000]
        if not past and min(versions, default=1) > 1:
            raise ValueError(f"table {self.spec.name} no longer keeps its state of {as_of}")
        return max(past, default=0)

    # --- writing ------------------------------------------------------------------------------

    def _prepared(self, rows: DataFrame, op: str) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spec.schema.fields]
        kind = F.col("_op") if "_op" in rows.columns else F.lit(op)
        prepared = rows.select(*columns, kind.alias("_op"))
        return prepared.withColumns({n: F.expr(text) for n, text in self.spec.computed.items()})

    def _overwrite(self, rows: DataFrame, target: str, partition_by: Sequence[str], mode: str = "dynamic") -> None:
        """Write about one file per target size and partition, in place of what these partitions had.

        In ``static`` mode all of the folder is replaced, and has Spark's marker once it is complete.

        Rows are brought together by partition and bucket; adaptive execution splits a group that
        is larger than a file over several tasks and joins small ones, so neither a hot bucket nor
        many small buckets hurt. Spark turns it off in the batches of a stream with state, where every task would write
        a file for each partition: there it is on for the write, and keeps all cores at work, as the next batch waits.
        """
        spec, session = self.spec, rows.sparkSession
        in_batch = session.conf.get("spark.sql.adaptive.enabled") == "false"
        own = [c for c in partition_by if c in self.parts]
        # Hash buckets as partitions need no other ones within them.
        bucket_by = None if _BUCKET in own else spec.bucket_by
        with session_conf(session, write_options(spec.target_file_size, spread=in_batch)):
            out = brought_together(rows, own, bucket_by, spec.buckets) if own or bucket_by else rows
            if ordering := [*own, *[bucket_by] * bool(bucket_by)]:
                out = out.sortWithinPartitions(*ordering)
            (out.write.mode("overwrite").option("partitionOverwriteMode", mode)
             .partitionBy(*partition_by).parquet(target))

    def commit(
        self,
        rows: DataFrame,
        op: str = changelog.UPSERT,
        committed_ms: int | None = None,
        batch: str | None = None,
        again: bool = True,
    ) -> int:
        """Write the rows as one version and return its number.

        ``batch`` is the name a stream gives to one of its batches: a batch of this name that was committed before
        is replaced under its old number. ``again`` False says that there is none, which spares the search for it. An
        ``_op`` column in the rows overrides ``op``. A commit without rows leaves no version.
        """
        versions = self.versions()
        before = self.version_of_batch(batch) if batch is not None and again and versions else None
        version = max(versions, default=0) + 1 if before is None else before
        millis = versions.get(version) or (int(time.time() * 1000) if committed_ms is None else committed_ms)
        log = self._prepared(rows, op).withColumns({
            "_batch": F.lit(batch).cast("string"), "_commit_version": F.lit(version).cast("bigint"),
            "_commit_ms": F.lit(millis).cast("bigint")})
        self._overwrite(log, self.log_path, ["_commit_version", "_commit_ms", *self.spec.partition_by])
        written = f"{self.log_path}/_commit_version={version}"
        if self.spec.keys and folders.exists(self.spark, written):
            # Only the new folder is listed and read, however long the log is.
            changes = self.spark.read.schema(self.log_schema()).option("basePath", self.log_path).parquet(written)
            self._merge(self._in_state(self._with_commit_time(changes)), from_log=before is not None)
        return version

    def _groups(self) -> list[str]:
        return [*self.spec.keys, *[c for c in self.parts if c not in self.spec.keys]]

    def _in_state(self, changes: DataFrame) -> DataFrame:
        """Changes as rows of the state, with the column it is partitioned by."""
        if self.spec.partition_by:
            return changes
        return changes.withColumn(_BUCKET, F.pmod(F.hash(*self.spec.keys), F.lit(self.spec.buckets)))

    def _touched(self, changes: DataFrame) -> Column:
        """A filter for the partitions of the changes, which prunes folders; only their names come to the driver."""
        types = {f.name: f.dataType for f in changes.schema.fields}
        values = changes.select(*[F.col(c).cast("string") for c in self.parts]).distinct().collect()
        if len(self.parts) == 1:
            name = self.parts[0]
            known = [F.lit(v[0]).cast(types[name]) for v in values if v[0] is not None]
            chosen = F.col(name).isin(*known) if known else F.lit(False)
            return chosen | F.col(name).isNull() if len(known) < len(values) else chosen
        chosen = F.lit(False)
        for value in values:
            same = F.lit(True)
            for name, text in zip(self.parts, value):
                same = same & F.col(name).eqNullSafe(F.lit(text).cast(types[name]))
            chosen = chosen | same
        return chosen

    def _merge(self, changes: DataFrame, from_log: bool = False) -> None:
        """Fold changes into the partitions that they touch. Deletes stay as rows, so that no partition is without any."""
        touched, groups = self._touched(changes), self._groups()
        anew = from_log or not folders.exists(self.spark, self.state_path)
        log = self._in_state(self._log()).where(touched) if anew else changes
        last = changelog.last_changes(log.drop("_commit_ts"), groups, self.spec.order_by)
        if not anew:
            # The state has one row per key, older than any change: rows without a change need no grouping.
            same = F.lit(True)
            for key in groups:
                same = same & F.col(f"old.{key}").eqNullSafe(F.col(f"changed.{key}"))
            old = self._state().where(touched).drop("_commit_ts").alias("old")
            last = old.join(changes.select(*groups).distinct().alias("changed"), same, "left_anti").unionByName(last)
        self._overwrite(last, self.state_path, self.parts)

    def rebuild(self) -> None:
        """Merge the whole state from the log, after a job that failed halfway and is not run again."""
        if self.spec.keys and self.versions():
            self._merge(self._in_state(self._log()), from_log=True)

    def delete_where(self, condition: Column, committed_ms: int | None = None) -> int:
        """Delete the rows for which the condition is true, as a new version."""
        gone = changelog.delete_changes(self.read(), condition)
        return self.commit(gone, changelog.DELETE, committed_ms=committed_ms)

    # --- reading ------------------------------------------------------------------------------

    def _file_schema(self) -> T.StructType:
        spec = self.spec
        schema = T.StructType(list(spec.schema.fields))
        if spec.computed:
            shape = self.spark.createDataFrame([], spec.schema)
            shape = shape.select(*[F.expr(text).alias(n) for n, text in spec.computed.items()])
            schema = T.StructType(schema.fields + shape.schema.fields)
        return schema.add("_op", T.StringType())

    def log_schema(self) -> T.StructType:
        schema = self._file_schema().add("_batch", T.StringType())
        return schema.add("_commit_version", T.LongType()).add("_commit_ms", T.LongType())

    def _raw_log(self) -> DataFrame:
        if not folders.exists(self.spark, self.log_path):
            return self.spark.createDataFrame([], self.log_schema())
        return self.spark.read.schema(self.log_schema()).parquet(self.log_path)

    def _log(self) -> DataFrame:
        return self._with_commit_time(self._raw_log())

    def _state(self) -> DataFrame:
        """The last change of every key, with the partition column."""
        schema = self._file_schema().add("_commit_version", T.LongType())
        if not self.spec.partition_by:
            schema = schema.add(_BUCKET, T.IntegerType())
        if not folders.exists(self.spark, self.state_path):
            return self.spark.createDataFrame([], schema).withColumn("_commit_ts", F.lit(None).cast("timestamp"))
        return self.spark.read.schema(schema).parquet(self.state_path).withColumn("_commit_ts", F.lit(None).cast("timestamp"))

    def _with_commit_time(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            *self._columns(), "_op", "_commit_version",
            F.timestamp_millis("_commit_ms").alias("_commit_ts"),
        )

    def _columns(self) -> list[str]:
        return [*self.spec.schema.names, *self.spec.computed]

    def read(self, version: int | None = None, as_of: AsOf = None) -> DataFrame:
        """The rows of the table, now or at a version or moment.

        The present rows of a keyed table are a scan of its state. Earlier ones are merged from the log; the partition
        columns depend on the keys and are grouped with them, so filters on them reach the file listing.
        """
        if as_of is not None:
            version = self.version_at(as_of)
        if version is None and self.spec.keys:
            return self._state().where(F.col("_op") != changelog.DELETE).select(*self._columns())
        log = self._log()
        if version is not None:
            self._kept(version, self.versions())
            log = changelog.upto_version(log, version)
        if self.spec.keys:
            groups = [*self.spec.keys, *[c for c in self.spec.partition_by if c not in self.spec.keys]]
            return changelog.current_state(log, groups, self.spec.order_by).select(*self._columns())
        return changelog.not_deleted(log, self._columns())

    def change_log(self) -> DataFrame:
        """All kept changes, unmerged."""
        return self._log()

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """The changes of the versions ``after < version <= upto``; only their folders are read."""
        versions = self.versions()
        self._kept(after, versions)
        return changelog.between_versions(self._log(), after, max(versions, default=0) if upto is None else upto)

    def snapshots(self) -> DataFrame:
        return changelog.snapshots(self.change_log())

    def follow(self) -> DataFrame:
        """The changes as a stream of the log's files, of which the follower's checkpoint remembers what it has read.

        A file is read once, but a change may come again, when its batch was run again or its version was folded: a
        follower of a keyed table should take the keys that changed and read their present rows.
        """
        folders.make(self.spark, self.log_path)
        return self._with_commit_time(self.spark.readStream.schema(self.log_schema()).parquet(self.log_path))
