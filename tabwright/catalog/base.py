"""Registration of queries and the helpers their check SQL shares."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}

MODULES = (
    "profiling",
    "quality",
    "cleaning",
    "features",
    "learning",
    "evaluation",
    "leaderboards",
    "anomalies",
    "clusters",
    "explanations",
    "models",
    "trees",
    "first_order",
    "inputs",
)


def query(name: str, *covers: str, sql: str | None = None):
    """Register a query under `name` for the listed inventory ids."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tabwright.catalog.{module}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row or reads the rows many times: at least one partition per core.

    Files with few row groups come as few splits and would leave cores idle. A table with more
    splits than cores, as any large one has, is taken as it is.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def sql_order_stat(column: str, p: float) -> str:
    """`sorted(values)[floor(n*p)]` in the checking engine."""
    position = f"least(CAST(floor(count({column}) * {p}) AS BIGINT) + 1, count({column}))"
    return f"list_extract(list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL)), {position})"
