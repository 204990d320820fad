"""Vector distances and nearest neighbours in whole-stage code, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("different vector dimensions")).cast("double"))
    return same.otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def vector_norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def vector_dims(a: Column) -> Column:
    return F.size(a)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL where a vector has no length."""
    n = vector_norm(a) * vector_norm(b)
    return F.when(n > 0, 1 - inner_product(a, b) / F.when(n > 0, n))


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "l1": l1_distance, "inner_product": lambda a, b: -inner_product(a, b)}


def knn(rows: DataFrame, vector: str, query: list[float], k: int, metric: str = "cosine", key: str | None = None) -> DataFrame:
    """ORDER BY vector <op> query LIMIT k, exact: one scan, a heap of k for each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    order = [F.col("distance").asc_nulls_last()] + ([F.col(key).asc()] if key else [])
    return rows.withColumn("distance", METRICS[metric](F.col(vector), q)).orderBy(*order).limit(k)


def rrf_score(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank): what one ranked list adds."""
    return 1.0 / (F.lit(k) + rank)


def fuse_ranked(lists: list[DataFrame], key: str, order: list[Column], k: int = 60, depth: int = 100) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked lists, each cut to its first `depth` rows before it is numbered."""
    parts = []
    for df, o in zip(lists, order):
        top = df.orderBy(o, F.col(key)).limit(depth)
        parts.append(top.select(key, rrf_score(F.row_number().over(Window.orderBy(o, F.col(key))), k).alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))
