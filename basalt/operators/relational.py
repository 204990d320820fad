"""Ordering, limits, distinctness, joins and set operations with the dialect's semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asc(c: Column | str) -> Column:
    """Ascending with NULL as the largest value."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending with NULL as the largest value, so first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def top_n(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """ORDER BY .. LIMIT n OFFSET m: a bounded heap for each partition (TakeOrderedAndProject)."""
    if n < 0 or offset < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(n)


def limit_with_ties(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: rows after the offset up to the peers of the last one.

    The n + offset smallest keys are found by a top-n; all rows up to the last of those keys are then
    kept by rank over that bounded prefix, so the whole table is never sorted in one task.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    if n == 0:
        return df.limit(0)
    tagged = df.withColumn("__id", F.monotonically_increasing_id())
    w = Window.orderBy(*order)
    first = top_n(tagged, order, n + offset).withColumn("__rn", F.row_number().over(w))
    last = first.where(F.col("__rn") == n + offset)
    raw = [F.col(_name(o)) for o in order]
    edge = last.select(*[c.alias(k) for c, k in zip(raw, keys)])
    peers = tagged.join(F.broadcast(edge), [c.eqNullSafe(F.col(k)) for c, k in zip(raw, keys)], "left_semi")  # one row
    kept = first.where(F.col("__rn") > offset).select(*df.columns, "__id")
    more = peers.join(first.select("__id"), "__id", "left_anti").select(*df.columns, "__id")
    return kept.unionByName(more).select(*df.columns)


def _name(order: Column) -> str:
    return str(order._jc.toString() if hasattr(order, "_jc") else order).split(" ")[0].strip("`")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON (keys): the first row of each key in the given order; NULL keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def join_using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """JOIN .. USING: each named column once, as coalesce(left, right)."""
    return left.join(right, columns, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN over all common column names; without one, every pair of rows."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def any_all(left: DataFrame, value: Column, right: DataFrame, other: str, op: str, quantifier: str) -> Column | DataFrame:
    """Rows of left with `value op ANY|ALL (SELECT other FROM right)` as a nullable `matched` column.

    Inequalities need only the extremes, the count and whether NULLs occur: one aggregate row, no pairs.
    """
    if op not in ("<", "<=", ">", ">=") or quantifier not in ("ANY", "ALL"):
        raise ValueError("use IN / NOT IN for equality; op must be an inequality")
    s = right.agg(F.min(other).alias("__lo"), F.max(other).alias("__hi"), F.count("*").alias("__n"), F.count(other).alias("__m"))
    small = op in (">", ">=")
    edge = F.col("__lo") if small == (quantifier == "ANY") else F.col("__hi")
    hit = {"<": value < edge, "<=": value <= edge, ">": value > edge, ">=": value >= edge}[op]
    nulls = F.col("__m") < F.col("__n")
    if quantifier == "ANY":
        got = F.when(F.col("__n") == 0, F.lit(False)).when(hit, F.lit(True)).when(nulls | value.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    else:
        got = F.when(F.col("__n") == 0, F.lit(True)).when((F.col("__m") > 0) & ~hit, F.lit(False)).when(nulls | value.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return left.crossJoin(F.broadcast(s)).withColumn("matched", got).drop("__lo", "__hi", "__n", "__m")


def top_k_per_row(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], k: int, how: str = "inner") -> DataFrame:
    """LEFT/INNER JOIN LATERAL (SELECT .. WHERE keys equal ORDER BY .. LIMIT k): ranked once for each key."""
    w = Window.partitionBy(*on).orderBy(*order)
    best = right.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
    return left.join(best, on, how)


def between(value: Column, low: Column, high: Column, symmetric: bool = False) -> Column:
    """BETWEEN that is NULL whenever an operand is."""
    if symmetric:
        low, high = F.least(low, high), F.greatest(low, high)
    return F.when(value.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("boolean")).otherwise((value >= low) & (value <= high))


def union(*parts: DataFrame, all: bool = False) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if all else out.distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Multiset minimum of counts with all=True."""
    return a.intersectAll(b) if all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Multiset difference of counts, at least zero, with all=True."""
    return a.exceptAll(b) if all else a.subtract(b)
