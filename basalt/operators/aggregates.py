"""Aggregates whose typing, NULL or ordering rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_exact(c: Column) -> Column:
    """SUM of BIGINT as an exact number beyond 64 bits."""
    return F.sum(c.cast("decimal(38,0)"))


def avg_exact(c: Column, scale: int = 16) -> Column:
    """AVG of an integer or decimal column as an exact number."""
    return (F.sum(c.cast(f"decimal(28,{min(scale, 10)})")) / F.count(c)).cast(f"decimal(38,{scale})")


def count_rows(*cols: Column) -> Column:
    """COUNT(DISTINCT (a, b)): rows count even if a member is NULL."""
    return F.count_distinct(F.struct(*cols))


def _ordered(value: Column, order: Column | None, descending: bool) -> Column:
    """Values of a group as array of structs (order, value), sorted with NULL as the largest key."""
    key = F.lit(0) if order is None else order
    packed = F.collect_list(F.struct(key.isNull().alias("n"), key.alias("o"), value.alias("v")))
    out = F.array_sort(packed) if order is not None else packed
    return F.reverse(out) if descending else out


def array_agg(value: Column, order: Column | None = None, descending: bool = False) -> Column:
    """ARRAY_AGG(v ORDER BY o): NULL elements stay, an empty group gives NULL."""
    got = _ordered(value, order, descending)
    return F.when(F.size(got) > 0, F.transform(got, lambda s: s["v"]))


def string_agg(value: Column, sep: str, order: Column | None = None, descending: bool = False) -> Column:
    """STRING_AGG(v, sep ORDER BY o): NULLs are skipped, nothing left gives NULL."""
    got = F.filter(F.transform(_ordered(value, order, descending), lambda s: s["v"]), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, F.array_join(got, sep))


def json_agg(value: Column, order: Column | None = None, descending: bool = False) -> Column:
    """JSON_AGG as text; a NULL becomes null, an empty group NULL."""
    got = F.transform(_ordered(value, order, descending), lambda s: F.coalesce(F.regexp_extract(F.to_json(F.array(s["v"])), r"(?s)^\[(.*)\]$", 1), F.lit("null")))
    return F.when(F.size(got) > 0, F.concat(F.lit("["), F.array_join(got, ","), F.lit("]")))


def json_object_agg(key: Column, value: Column) -> Column:
    """JSON_OBJECT_AGG as text, keys in order; a NULL key is an error, the last of equal keys wins."""
    checked = F.when(key.isNull(), F.raise_error(F.lit("field name must not be null"))).otherwise(key.cast("string"))
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(checked, value)))), {"ignoreNullFields": "false"})


def mode(value: Column) -> Column:
    """MODE() WITHIN GROUP (ORDER BY v): the smallest of the most frequent values."""
    return F.mode(value, True)


def _before(args: list, cols: list[Column], descending: list[bool], equal_too: bool) -> Column:
    """Whether the row's keys come before the hypothetical ones (or are their peers)."""
    out = F.lit(equal_too)
    for a, c, d in reversed(list(zip(args, cols, descending))):
        a = F.lit(a)
        less = (c > a) if d else (c < a)
        if d:
            less = F.coalesce(less, c.isNull() & a.isNotNull())
        else:
            less = F.coalesce(less, c.isNotNull() & a.isNull())
        out = less | (c.eqNullSafe(a) & out)
    return out


def hypothetical_rank(args: list, cols: list[Column], descending: list[bool] | None = None) -> Column:
    d = descending or [False] * len(cols)
    return 1 + F.count_if(_before(args, cols, d, False))


def hypothetical_dense_rank(args: list, cols: list[Column], descending: list[bool] | None = None) -> Column:
    d = descending or [False] * len(cols)
    return 1 + F.count_distinct(F.when(_before(args, cols, d, False), F.struct(*cols)))


def hypothetical_percent_rank(args: list, cols: list[Column], descending: list[bool] | None = None) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise((hypothetical_rank(args, cols, descending) - 1) / n)


def hypothetical_cume_dist(args: list, cols: list[Column], descending: list[bool] | None = None) -> Column:
    d = descending or [False] * len(cols)
    return (F.count_if(_before(args, cols, d, True)) + 1) / (F.count(F.lit(1)) + 1)


def with_filter(aggregate, value: Column, predicate: Column) -> Column:
    """agg(v) FILTER (WHERE p): the rest counts as NULL."""
    return aggregate(F.when(predicate, value))
