"""Set-returning functions as generators: one row for each element, with optional ordinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column, name: str = "unnest", ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """Rows of df times the elements of an array; ordinality counts from 1."""
    if ordinality is None:
        return df.withColumn(name, (F.explode_outer if outer else F.explode)(array))
    out = df.select("*", (F.posexplode_outer if outer else F.posexplode)(array).alias(ordinality, name))
    return out.withColumn(ordinality, (F.col(ordinality) + 1).cast("bigint"))


def unnest_zip(df: DataFrame, arrays: dict[str, Column], ordinality: str | None = None) -> DataFrame:
    """UNNEST(a, b, ..): arrays side by side, the shorter ones padded with NULL."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    out = df.select("*", F.posexplode(zipped).alias("__i", "__z"))
    cols = [F.col("__z").getField(n).alias(n) for n in arrays]
    return out.select(*df.columns, *cols, *([(F.col("__i") + 1).cast("bigint").alias(ordinality)] if ordinality else []))


def generate_series(spark, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """The inclusive series; a distributed range, empty if the step leads away."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    end = stop + (1 if step > 0 else -1)
    return spark.range(start, end, step).withColumnRenamed("id", name)


def regexp_split_to_table(df: DataFrame, s: Column, pattern: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.split(s, pattern, -1)))


def string_to_table(df: DataFrame, s: Column, sep: str, name: str) -> DataFrame:
    from .arrays import string_to_array

    return df.withColumn(name, F.explode(string_to_array(s, sep)))


def regexp_matches(df: DataFrame, s: Column, pattern: str, name: str, flags: str = "") -> DataFrame:
    """One row for each match's groups with the flag g, else for the first match only."""
    from .text import regexp_match, regexp_matches_all

    if "g" in flags:
        return df.withColumn(name, F.explode(regexp_matches_all(s, pattern, flags)))
    return df.withColumn(name, regexp_match(s, pattern, flags)).where(F.col(name).isNotNull())
