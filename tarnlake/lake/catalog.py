"""Databases, tables and their description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.lake import folders
from tarnlake.lake.table import LakeTable
from tarnlake.schemas import TABLES, TableSpec


class Catalog:
    """The tables of a warehouse folder: ``<warehouse>/<database>/<table>``."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark = spark
        self.warehouse = warehouse.rstrip("/")
        self.database: str | None = None
        self._views: set[str] = set()

    def create_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{self.warehouse}/{name}'")
        folders.make(self.spark, f"{self.warehouse}/{name}")

    def use(self, name: str) -> None:
        """Make a database the current one; the views of the one before are gone."""
        self.spark.catalog.setCurrentDatabase(name)
        for view in self._views:
            self.spark.catalog.dropTempView(view)
        self._views.clear()
        self.database = name

    def _current(self) -> str:
        if self.database is None:
            raise ValueError("no database is in use")
        return self.database

    def table(self, spec: TableSpec | str) -> LakeTable:
        spec = TABLES[spec] if isinstance(spec, str) else spec
        return LakeTable(self.spark, spec, f"{self.warehouse}/{self._current()}/{spec.name}")

    def create_table(self, spec: TableSpec | str, if_not_exists: bool = True) -> LakeTable:
        table = self.table(spec)
        if folders.exists(self.spark, table.path) and not if_not_exists:
            raise ValueError(f"table {table.spec.name} exists")
        return table.create()

    def register(self, spec: TableSpec | str) -> None:
        """Make the table's present state a view for SQL; call again after commits.

        The view has the table's name as long as its database is in use, and always
        ``<database>__<table>``.
        """
        table = self.table(spec)
        state = table.read()
        state.createOrReplaceTempView(table.spec.name)
        state.createOrReplaceTempView(f"{self._current()}__{table.spec.name}")
        self._views.add(table.spec.name)

    def show_tables(self) -> DataFrame:
        """The tables of the current database, created here or not."""
        paths = folders.matching(self.spark, f"{self.warehouse}/{self._current()}/*")
        names = [(path.rsplit("/", 1)[1],) for path in paths]
        return self.spark.createDataFrame(names, "table_name string")

    def show_databases(self) -> DataFrame:
        return self.spark.sql("SHOW DATABASES").select(F.col("namespace").alias("database_name"))

    def show_catalogs(self) -> DataFrame:
        return self.spark.sql("SHOW CATALOGS").select(F.col("catalog").alias("catalog_name"))

    def describe(self, spec: TableSpec | str) -> DataFrame:
        """Name, type, key and partition flags of the columns."""
        table = self.table(spec)
        rows = [
            (f.name, f.dataType.simpleString(), f.name in table.spec.keys,
             f.name in table.spec.partition_by, table.spec.computed.get(f.name))
            for f in table._file_schema().fields if f.name != "_op"
        ]
        return self.spark.createDataFrame(
            rows, "column_name string, data_type string, is_key boolean, is_partition boolean, "
                  "computed_as string"
        )


def explain(df: DataFrame) -> str:
    """The formatted plan as text."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
