"""Registration of named queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its equivalent."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nulled(key: str, every: int, column: str) -> Column:
    """``column`` with a null in every row whose key is a multiple of ``every``."""
    return F.when(F.col(key) % every != 0, F.col(column))


def sql_list(values) -> str:
    """SQL list of texts."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
