"""Session settings and table registration for the dialect's semantics."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that the dialect's results rest on: errors instead of silent NULLs, UTC, exact decimal quotients.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def configure(spark: SparkSession) -> SparkSession:
    """The session with the dialect's runtime settings."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views over folder/<name>.parquet; Catalyst prunes columns and pushes filters to the scan."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
