"""Sinks: appends, versioned snapshots (the stand-in for refreshed views and updates), truncation, view registration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


class Snapshots:
    """A table that is replaced as a whole: each version is a folder, a one-row table names the current one.

    Readers keep the version they began with, so a table may be computed from its own last version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self) -> str | None:
        try:
            rows = self.spark.read.json(f"{self.root}/_current").select("version", "n").orderBy(F.desc("n")).take(1)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows[0]["version"] if rows else None

    def exists(self) -> bool:
        return self._current() is not None

    def read(self) -> DataFrame:
        version = self._current()
        if version is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{version}")

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{version}")
        path = f"{self.root}/_current"
        n = self.spark.read.json(path).count() if self.exists() else 0
        self.spark.createDataFrame([(version, n)], "version string, n long").coalesce(1).write.mode("append").json(path)

    def truncate(self) -> None:
        self.replace(self.read().limit(0))

    def upsert(self, rows: DataFrame, key: str) -> None:
        from ..operators.accounts import upsert

        self.replace(upsert(self.read(), rows, key) if self.exists() else rows)


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables available to SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def described(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, temporary, column, type): the tables and views that SQL knows in a database."""
    found = spark.catalog.listTables(database)
    rows = [(t.name, t.isTemporary, c.name, c.dataType) for t in found for c in spark.catalog.listColumns(t.name if t.isTemporary else ".".join([*t.namespace, t.name]))]
    return spark.createDataFrame(rows, "table string, temporary boolean, column string, type string")
