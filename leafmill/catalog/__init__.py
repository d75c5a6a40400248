"""Queries over the driver's tables, by group; each registers itself with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its own or the given name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def question(name: str, sql: str, oracle: str | None = None, table_functions: bool = False) -> None:
    """Registers a question in SQL: it goes through the sandbox's check, with the tables that it names as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import re

        words = set(re.findall(r"\w+", sql.lower()))
        return Tables(spark, {n: read(spark, sf_dir, n) for n in NAMES if n in words}, table_functions).frame(sql)

    query(oracle or sql, name)(run)
