"""Where modules of queries register each query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """Reads the tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None) -> Callable:
    """Register a function of (spark, reader of a table by name) under its name, with its SQL if SQL can state it."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, Tables(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
