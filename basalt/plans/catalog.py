"""Registry of the analytic queries: a Spark plan and, where SQL can express it, the SQL to hold it against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Decorator: the query of this name, with its SQL."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def register_sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query in Spark SQL over the tables it names; oracle: other SQL for the same rows, if it is spelled differently."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", spark_sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    run.__name__ = name
    register(name, oracle or spark_sql)(run)


def load() -> None:
    """Import the modules that register queries."""
    from . import aggregation, expressions, functions, relational, special, surface, tpch, windowing  # noqa: F401


load()
