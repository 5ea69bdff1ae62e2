"""Jobs that keep lake tables small: compaction, expiry, retention, copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.moments import AsOf, day_of, moment
from tarnlake.lake import changelog, folders
from tarnlake.lake.table import LakeTable, brought_together, write_options
from tarnlake.session import session_conf

# Defaults of expiry and compaction.
EXPIRE_AFTER = timedelta(days=7)
KEEP_AT_LEAST = 10
SMALL_FILE_BYTES = 32 * 1024 * 1024


def compact(table: LakeTable) -> int:
    """Write the partitions of the state that have small files or deletes again; returns how many.

    A merge leaves few files, so this is for partitions that many small commits have touched, and for the
    rows that remember deletes. A partition with nothing but deletes goes. Append tables are left as they are.
    """
    if not table.spec.keys or not folders.exists(table.spark, table.state_path):
        return 0
    state, parts = table._state().drop("_commit_ts"), list(table.parts)
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    judged = state.groupBy(*parts).agg(
        F.count_distinct(path).alias("files"), F.min(size).alias("least"),
        F.sum((F.col("_op") == changelog.DELETE).cast("bigint")).alias("gone"), F.count("*").alias("all"))
    judged = judged.where(((F.col("files") > 1) & (F.col("least") < SMALL_FILE_BYTES)) | (F.col("gone") > 0)).select(
        *parts, (F.col("gone") == F.col("all")).alias("empty")).persist()
    try:
        rewritten = judged.where("NOT empty").select(*parts)
        count = judged.count()
        if not rewritten.isEmpty():
            left = state.where(table._touched(rewritten)).where(F.col("_op") != changelog.DELETE)
            table._overwrite(left, table.state_path, parts)
        empty = judged.where("empty").select(*parts)
        if not empty.isEmpty():
            inside = state.where(table._touched(empty)).select(path.alias("path")).distinct()
            for folder in {row.path.rsplit("/", 1)[0] for row in inside.collect()}:
                folders.delete(table.spark, folder)
    finally:
        judged.unpersist()
    return count


def small_files(table: LakeTable, threshold: int = SMALL_FILE_BYTES) -> DataFrame:
    """The live files below the threshold: a table with many of them is worth compacting."""
    return files(table).where(F.col("bytes") < threshold)


def compact_if_needed(table: LakeTable, threshold: int = SMALL_FILE_BYTES, at_least: int = 2) -> int | None:
    """Compact when the newest state has several small files."""
    if small_files(table, threshold).count() < at_least:
        return None
    return compact(table)


def files(table: LakeTable) -> DataFrame:
    """Path, bytes and rows of the files that make up the newest state.

    Sizes and counts come from file metadata; no column is read.
    """
    path = table.state_path if table.spec.keys else table.log_path
    if not folders.exists(table.spark, path):
        return table.spark.createDataFrame([], "file_path string, bytes bigint, row_count bigint")
    rows = table.spark.read.schema(table.log_schema()).parquet(path)
    return rows.groupBy(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count("*").alias("row_count"))


def column_statistics(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Rows, NULLs, smallest, greatest and distinct values of columns, one row per column.

    The number of distinct values is estimated by default, as table statistics usually are; the
    exact one counts (column, value) groups, which spreads every column over the cluster.
    """
    def text(value):
        return value.cast("string")

    parts = {}
    for i, name in enumerate(columns):
        parts[name] = F.struct(
            F.lit(name).alias("column_name"),
            F.count("*").alias("row_count"),
            (F.count("*") - F.count(name)).alias("null_count"),
            text(F.min(name)).alias("min_value"),
            text(F.max(name)).alias("max_value"),
            *([] if exact else [F.approx_count_distinct(name).alias("distinct_count")]),
        )
    summary = df.agg(F.array(*parts.values()).alias("stats")).select(F.inline("stats"))
    if not exact:
        return summary
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("column_name"), text(F.col(name)).alias("value")) for name in columns
    ])).alias("cell")).select("cell.*")
    distinct = (
        values.where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.lit(1).alias("one"))
        .groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    )
    return summary.join(distinct, "column_name", "left").withColumn(
        "distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint"))
    )


def expire_snapshots(
    table: LakeTable,
    now: datetime,
    older_than: timedelta = EXPIRE_AFTER,
    keep_at_least: int = KEEP_AT_LEAST,
    keep_at_most: int | None = None,
) -> int | None:
    """Forget versions that are too old, never the newest ``keep_at_least``; returns the last one.

    With ``keep_at_most``, younger versions beyond that number go too. What the table was at the last expired
    version takes the place of that version and all before it, so every later one can still be read. The
    present rows are not touched. An append table has no history apart from its rows and is left as it is.
    """
    finish_folding(table)
    versions = table.versions()
    numbers = sorted(versions)
    limit = (now - older_than).timestamp() * 1000
    # The first version may be what is left of an expiry.
    start = 1 if numbers and numbers[0] > 1 else 0
    removable = numbers[start:][: max(len(numbers) - start - max(keep_at_least, 1), 0)]
    surplus = 0 if keep_at_most is None else max(len(numbers) - start - keep_at_most, 0)
    expired = []
    for i, number in enumerate(removable):
        if i >= surplus and versions[number] >= limit:
            break
        expired.append(number)
    if not expired or not table.spec.keys:
        return None
    fold(table, expired[-1])
    return expired[-1]


def fold(table: LakeTable, version: int) -> None:
    """Make a version the first that is kept: its folder gets all rows of that time, older folders go.

    The rows are written aside first. A run that stops in between is ended by the next one, or by
    ``finish_folding``; until then reads of history may lack rows, reads of the present do not.
    """
    millis = table.versions()[version]
    rows = table._prepared(table.read(version), changelog.UPSERT).withColumns({
        "_batch": F.lit(None).cast("string"), "_commit_version": F.lit(version).cast("bigint"),
        "_commit_ms": F.lit(millis).cast("bigint")})
    aside = f"{table.path}/folding"
    table._overwrite(rows, aside, ["_commit_version", "_commit_ms", *table.spec.partition_by], "static")
    finish_folding(table)


def finish_folding(table: LakeTable) -> None:
    """Put a folded version that is written completely in the place of its log folders."""
    aside = f"{table.path}/folding"
    if folders.exists(table.spark, f"{aside}/_SUCCESS"):
        for path in folders.matching(table.spark, f"{aside}/_commit_version=*"):
            last = int(folders.value_of(path, "_commit_version"))
            for number in table.versions():
                if number <= last:
                    folders.delete(table.spark, f"{table.log_path}/_commit_version={number}")
            folders.rename(table.spark, path, f"{table.log_path}/_commit_version={last}")
    folders.delete(table.spark, aside)


def drop_partitions_before(table: LakeTable, day: date | str, column: str | None = None) -> int:
    """Remove the partitions of days before ``day`` now and in all versions; returns how many folders.

    Only folders are removed and nothing is rewritten. Earlier versions lose these days too, which
    is what a retention asks for.
    """
    column = column or table.spec.partition_by[0]
    inside = "".join(f"/{c}=*" for c in table.spec.partition_by[: table.spec.partition_by.index(column) + 1])
    dropped = 0
    for root in (f"{table.log_path}/_commit_version=*/_commit_ms=*", table.state_path):
        for path in folders.matching(table.spark, root + inside):
            value = folders.value_of(path, column)
            if value[:4].isdigit() and value < str(day):
                folders.delete(table.spark, path)
                dropped += 1
    return dropped


def _date_partition(table: LakeTable) -> str | None:
    schema = table._file_schema()
    for name in table.spec.partition_by:
        if isinstance(schema[name].dataType, T.DateType):
            return name
    return None


def apply_retention(
    config: LakeTable, tables: Mapping[str, LakeTable], as_of: AsOf
) -> DataFrame:
    """Delete what the configuration table says is too old; returns the configuration after it.

    A table with a date partition loses whole folders, another one gets delete rows. The
    configuration has one row per table.
    """
    spark = config.spark
    rows = config.read().where("cleanup_enabled").select(
        "table_name", F.date_sub(day_of(as_of), F.col("retention_days")).alias("first_day")
    ).where(F.col("table_name").isin(*tables)).collect()
    for row in rows:
        table = tables[row.table_name]
        partition = _date_partition(table)
        if partition:
            drop_partitions_before(table, row.first_day, partition)
        elif table.spec.time_column:
            first = moment(row.first_day, T.TimestampType())
            table.delete_where(F.col(table.spec.time_column) < first)
        else:
            raise ValueError(f"table {row.table_name} has no time to apply a retention to")
    done = config.read().where(F.col("table_name").isin(*[row.table_name for row in rows]))
    config.commit(done.withColumn("last_cleanup_time", moment(as_of, T.TimestampType())))
    return config.read()


def backup(df: DataFrame, path: str) -> None:
    """Copy a table to a folder together with the row count and checksum of the source.

    The copy is read back and compared with the source before it takes the place of an older one.
    """
    spark = df.sparkSession
    expected = _fingerprint(df).first()
    df.write.mode("overwrite").parquet(f"{path}/new")
    found = _fingerprint(spark.read.parquet(f"{path}/new")).first()
    if found != expected:
        raise ValueError(f"the copy in {path} is not like its source: {found} instead of {expected}")
    spark.createDataFrame([expected], "row_count bigint, checksum decimal(38,0)").write.mode("overwrite").parquet(f"{path}/manifest")
    folders.delete(spark, f"{path}/data")
    folders.rename(spark, f"{path}/new", f"{path}/data")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a backup, after its count and checksum were verified."""
    rows = spark.read.parquet(f"{path}/data")
    expected = spark.read.parquet(f"{path}/manifest").first()
    found = _fingerprint(rows).first()
    if expected != found:
        raise ValueError(f"backup {path} is damaged: {found} instead of {expected}")
    return rows


def _fingerprint(df: DataFrame) -> DataFrame:
    # A sum of row hashes does not depend on the order of the rows.
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        .alias("checksum"),
    )


def write_bucketed(
    df: DataFrame,
    table_name: str,
    key: str,
    buckets: int,
    sort_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    path: str | None = None,
    target_file_size: str = "64MB",
) -> None:
    """A table that is hash-distributed on a key and sorted in its buckets.

    Joins and aggregates on the key need no shuffle. Rows of a bucket are brought together before
    the write, and a bucket that is larger than a file is split over several tasks and files.
    """
    rows = brought_together(df, partition_by, key, buckets)
    writer = rows.write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, key).sortBy(*(sort_by or [key]))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    with session_conf(df.sparkSession, write_options(target_file_size)):
        writer.saveAsTable(table_name)
