"""Where a query and the SQL that says the same are put side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saldo.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.folders = spark, folder, {}

    def folder_of(self, name: str) -> str:
        """A folder of this run's own, the same for the same name."""
        if name not in self.folders:
            self.folders[name] = new_folder(self.spark)
        return self.folders[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a plan over Tables under its name, with its SQL if there is one."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register
