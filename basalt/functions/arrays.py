"""Array functions: one-based, NULL elements count as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cardinality(a: Column) -> Column:
    return F.size(a)


def array_length(a: Column, dim: int = 1) -> Column:
    """NULL for an empty array and for any dimension but the first."""
    return F.when((F.size(a) > 0) & F.lit(dim == 1), F.size(a))


array_upper = array_length


def array_lower(a: Column, dim: int = 1) -> Column:
    return F.when((F.size(a) > 0) & F.lit(dim == 1), F.lit(1))


def array_ndims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


def array_dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def array_fill(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)


def array_to_string(a: Column, sep: str, null: str | None = None) -> Column:
    text = F.transform(a, lambda x: x.cast("string"))
    return F.array_join(text, sep) if null is None else F.array_join(text, sep, null)


def string_to_array(s: Column, sep: str | None, null: str | None = None) -> Column:
    """A NULL separator splits into characters, '' gives one element; an empty text gives no elements."""
    import re

    whole = F.array(s) if sep == "" else F.split(s, "" if sep is None else re.escape(sep), -1)
    out = F.when(s == "", F.array().cast("array<string>")).otherwise(whole)
    return out if null is None else F.transform(out, lambda x: F.when(x != null, x))


def array_append(a: Column, x: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.array_append(a, x))


def array_prepend(x: Column, a: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.array_prepend(a, x))


def array_cat(a: Column, b: Column) -> Column:
    return F.coalesce(F.concat(a, b), a, b)


def array_position(a: Column, x: Column) -> Column:
    return F.get(array_positions(a, x), F.lit(0))


def array_positions(a: Column, x: Column) -> Column:
    at = F.transform(a, lambda e, i: F.when(e.eqNullSafe(x), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def array_remove(a: Column, x: Column) -> Column:
    return F.filter(a, lambda e: ~e.eqNullSafe(x))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda e: F.when(e.eqNullSafe(old), new).otherwise(e))


def trim_array(a: Column, n: int) -> Column:
    bad = F.raise_error(F.lit("number of elements to trim out of range"))
    return F.when(F.lit(n < 0) | (F.size(a) < n), bad).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0))))


def array_slice(a: Column, low: int | None, high: int | None) -> Column:
    """a[low:high] with bounds cut to the array."""
    lo = max(low or 1, 1) if low is not None else 1
    hi = F.size(a) if high is None else F.least(F.lit(high), F.size(a))
    return F.slice(a, F.lit(lo), F.greatest(hi - lo + 1, F.lit(0)))


def contains(a: Column, b: Column) -> Column:
    """a @> b: every element of b equals one of a; NULL equals nothing."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return F.coalesce(F.arrays_overlap(F.filter(a, lambda x: x.isNotNull()), F.filter(b, lambda x: x.isNotNull())), F.lit(False))


def any_of(op: str, x: Column, a: Column) -> Column:
    """x op ANY (a): three-valued, False for an empty array."""
    return F.exists(a, lambda e: _compare(op, x, e))


def all_of(op: str, x: Column, a: Column) -> Column:
    """x op ALL (a): three-valued, True for an empty array."""
    return F.forall(a, lambda e: _compare(op, x, e))


def _compare(op: str, x: Column, e: Column) -> Column:
    return {"=": x == e, "<>": x != e, "<": x < e, "<=": x <= e, ">": x > e, ">=": x >= e}[op]
