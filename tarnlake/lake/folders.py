"""Listing and deleting folders through the Hadoop file system API, for any storage Spark can use.

Only names are handled here, never data.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths for a glob pattern, sorted."""
    found = _file_system(spark, pattern).globStatus(_path(spark, pattern))
    return sorted(status.getPath().toString() for status in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def make(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).mkdirs(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(_path(spark, path), True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    if not _file_system(spark, old).rename(_path(spark, old), _path(spark, new)):
        raise OSError(f"{old} could not be renamed to {new}")


def value_of(path: str, column: str) -> str:
    """The value of a ``column=value`` part of a path."""
    for part in path.split("/"):
        if part.startswith(f"{column}="):
            return part[len(column) + 1:]
    raise ValueError(f"no {column} in {path}")
