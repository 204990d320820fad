"""Arithmetic and numeric functions with the dialect's rounding and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide_int(a: Column, b: Column) -> Column:
    """INT / INT: truncating, an error on zero."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise((F.sign(a) * F.sign(b)).cast("bigint") * F.floor(F.abs(a) / F.abs(b)).cast("bigint"))


def round_float(x: Column, d: int = 0) -> Column:
    """ROUND of a FLOAT: half to even."""
    return F.bround(x, d)


def round_numeric(x: Column, d: int = 0) -> Column:
    """ROUND of a NUMERIC: half away from zero."""
    return F.round(x, d)


def to_int(x: Column) -> Column:
    """FLOAT to INT: half to even."""
    return F.bround(x).cast("bigint")


def trunc(x: Column, d: int = 0) -> Column:
    """TRUNC toward zero to d places."""
    scale = F.lit(10.0**d)
    return F.when(x >= 0, F.floor(x * scale) / scale).otherwise(F.ceil(x * scale) / scale)


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(a % b)


def log(x: Column, base: float | None = None) -> Column:
    return F.log10(x) if base is None else F.log(x) / F.log(F.lit(base))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, unrolled by folding over as many steps as 64 bits can need."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, s["x"] % F.when(s["y"] != 0, s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(a.cast("bigint") * b.cast("bigint")) / gcd(a, b)).cast("bigint")


def factorial(n: Column) -> Column:
    return F.when((n < 0) | (n > 20), F.raise_error(F.lit("factorial argument out of range")).cast("bigint")).otherwise(F.factorial(n))


def width_bucket(x: Column, low: float, high: float, count: int) -> Column:
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(count))


def num_nulls(*cols: Column) -> Column:
    return sum((F.when(c.isNull(), 1).otherwise(0) for c in cols), F.lit(0))


def num_nonnulls(*cols: Column) -> Column:
    return F.lit(len(cols)) - num_nulls(*cols)


def scale(x: Column, declared: int) -> Column:
    return F.when(x.isNotNull(), F.lit(declared))


def min_scale(x: Column) -> Column:
    """Fewest fractional digits that hold a decimal."""
    text = F.regexp_replace(x.cast("string"), r"0+$", "")
    return F.when(F.contains(x.cast("string"), F.lit(".")), F.length(F.regexp_extract(text, r"\.(.*)$", 1))).when(x.isNotNull(), F.lit(0))


def trim_scale(x: Column) -> Column:
    """The text of a decimal without trailing fractional zeros (a column has one scale)."""
    s = x.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
