"""CSV files, relational databases and object storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line and declared types; a value of another type fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def literal_rows(spark: SparkSession, schema: T.StructType, rows: Sequence[tuple]) -> DataFrame:
    """``INSERT … VALUES``: a few rows written in the job itself."""
    return spark.createDataFrame(list(rows), schema)


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a read or write.

    A read without a partition column is one query in one task; a large table needs the column and
    its bounds, which set the stride only and never filter rows.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    optional = {
        "user": user, "password": password, "driver": driver, "partitionColumn": partition_column,
        "lowerBound": lower, "upperBound": upper, "numPartitions": partitions,
    }
    options.update({key: str(value) for key, value in optional.items() if value is not None})
    given = [partition_column is not None, lower is not None, upper is not None]
    if any(given) and not (all(given) and partitions):
        raise ValueError("partition_column, lower, upper and partitions belong together")
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def write_jdbc(df: DataFrame, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(**jdbc_options(**options)).mode(mode).save()


def object_store_conf(
    endpoint: str,
    access_key: str,
    secret_key: str,
    path_style: bool = True,
    region: str = "us-east-1",
    connections: int = 100,
) -> dict[str, str]:
    """Session settings for ``s3a://`` paths on an S3-compatible store."""
    prefix = "spark.hadoop.fs.s3a"
    return {
        f"{prefix}.endpoint": endpoint,
        f"{prefix}.access.key": access_key,
        f"{prefix}.secret.key": secret_key,
        f"{prefix}.path.style.access": str(path_style).lower(),
        f"{prefix}.endpoint.region": region,
        f"{prefix}.connection.maximum": str(connections),
        f"{prefix}.connection.ssl.enabled": str(endpoint.startswith("https")).lower(),
    }
