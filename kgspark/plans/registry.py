"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark.storage import Scratch


class Tables:
    """The input tables of one data folder, and scratch space for a query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._scratch = None

    def __getattr__(self, name: str) -> DataFrame:
        # Called for a table that was not asked for yet; kept as an attribute.
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    @property
    def scratch(self) -> Scratch:
        if self._scratch is None:
            self._scratch = Scratch(self.spark)
        return self._scratch


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an operator id and its SQL."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
