"""Session building and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What every deployment should run with. Parallelism is left to the cluster's own settings.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Sums of whole cents must fail on an overflow; without it they would become NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One shuffle partition of a rebalanced write becomes about one file of this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.parquet.compression.codec": "snappy",
    # Has a minimum and maximum per row group, which filters on time need.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Keeps streaming state off the JVM heap, so its size is bounded by local disk and not by memory;
# a checkpoint uploads the changes of a batch and not the whole state.
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(
    app_name: str = "tarnlake",
    cpus: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; ``cpus`` asks for a local one with that many threads."""
    builder = SparkSession.builder.appName(app_name)
    conf = dict(BASE_CONF)
    conf.update(STATE_STORE_CONF)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
        conf["spark.sql.shuffle.partitions"] = str(cpus)
        conf["spark.ui.enabled"] = "false"
        conf["spark.driver.memory"] = os.environ.get("TARNLAKE_DRIVER_MEMORY", "8g")
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Scratch folders that were given out, by application.
_given: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession, purpose: str, keep: bool = False) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors can reach.

    ``keep`` is for files that executors may fetch as long as the application runs: ``drop_scratch`` leaves them.

    Only a local session without that setting falls back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tarnlake-")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not keep:
        _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Remove all scratch folders of this application, once their results are no longer read."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below the shared folder and read back.

    For a result that several later jobs read: they neither compute it again nor depend on executors
    that may be lost.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]):
    """Set session options for one write and put the old values back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
