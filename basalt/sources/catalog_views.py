"""Metadata of the session's tables as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables over the session's catalog (a row for each table or view)."""
    rows = [(t.database or "public", t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession) -> DataFrame:
    """information_schema.columns."""
    rows = []
    for t in spark.catalog.listTables():
        for k, c in enumerate(spark.table(t.name).schema.fields, 1):
            rows.append((t.database or "public", t.name, c.name, k, "YES" if c.nullable else "NO", c.dataType.simpleString()))
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "schema_name string")


def views(spark: SparkSession) -> DataFrame:
    return tables(spark).where("table_type = 'VIEW'").drop("table_type")
