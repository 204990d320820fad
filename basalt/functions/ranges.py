"""Range values as structs (lower, upper, lower_inc, upper_inc, empty); a NULL bound is unbounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_range(lo: Column, hi: Column, bounds: str = "[)", step: str | None = None) -> Column:
    """A canonical range; step is 'int' or 'date' for discrete ranges, which become [lo, hi)."""
    if bounds not in ("[)", "(]", "[]", "()"):
        raise ValueError(f"invalid range bound flags {bounds!r}")
    li, ui = bounds[0] == "[", bounds[1] == "]"
    bad = F.when(lo > hi, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean"))
    if step:
        inc = (lambda c: c + 1) if step == "int" else (lambda c: F.date_add(c, 1))
        lo = lo if li else inc(lo)
        hi = inc(hi) if ui else hi
        li, ui = True, False
    empty = bad.otherwise(F.coalesce((lo > hi) | ((lo == hi) & F.lit(not (li and ui))), F.lit(False)))
    lo, hi = F.when(~empty, lo), F.when(~empty, hi)
    return F.struct(
        lo.alias("lower"), hi.alias("upper"), (F.lit(li) & lo.isNotNull()).alias("lower_inc"), (F.lit(ui) & hi.isNotNull()).alias("upper_inc"), empty.alias("empty")
    )


def lower(r: Column) -> Column:
    return r["lower"]


def upper(r: Column) -> Column:
    return r["upper"]


def isempty(r: Column) -> Column:
    return r["empty"]


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def contains_value(r: Column, x: Column) -> Column:
    """r @> x."""
    lo = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    hi = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return ~r["empty"] & lo & hi


def _starts_before_end(a: Column, b: Column) -> Column:
    """Whether a's lower bound lies at or before b's upper bound."""
    return a["lower"].isNull() | b["upper"].isNull() | (a["lower"] < b["upper"]) | ((a["lower"] == b["upper"]) & a["lower_inc"] & b["upper_inc"])


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return ~a["empty"] & ~b["empty"] & _starts_before_end(a, b) & _starts_before_end(b, a)


def contains(a: Column, b: Column) -> Column:
    """a @> b for ranges; an empty range lies in every range."""
    lo = a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))
    hi = a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))
    return b["empty"] | (~a["empty"] & F.coalesce(lo, F.lit(False)) & F.coalesce(hi, F.lit(False)))


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b: they touch without a gap or a shared point."""
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def strictly_left(a: Column, b: Column) -> Column:
    """a << b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def intersection(a: Column, b: Column) -> Column:
    lo = F.greatest(a["lower"], b["lower"])
    hi = F.least(a["upper"], b["upper"])
    inc = lambda side, v: F.coalesce(((a[side] != v) | a[f"{side}_inc"]) & ((b[side] != v) | b[f"{side}_inc"]), v.isNotNull() & (a[side].isNull() | (a[side] != v) | a[f"{side}_inc"]) & (b[side].isNull() | (b[side] != v) | b[f"{side}_inc"]))
    li, ui = inc("lower", lo), inc("upper", hi)
    empty = ~overlaps(a, b)
    return F.struct(F.when(~empty, lo).alias("lower"), F.when(~empty, hi).alias("upper"), (~empty & li & lo.isNotNull()).alias("lower_inc"), (~empty & ui & hi.isNotNull()).alias("upper_inc"), empty.alias("empty"))


def range_merge(a: Column, b: Column) -> Column:
    """The smallest range that covers both, gaps included."""
    lo = F.when(a["lower"].isNull() | b["lower"].isNull(), F.lit(None)).otherwise(F.least(a["lower"], b["lower"]))
    hi = F.when(a["upper"].isNull() | b["upper"].isNull(), F.lit(None)).otherwise(F.greatest(a["upper"], b["upper"]))
    li = ((a["lower"] == lo) & a["lower_inc"]) | ((b["lower"] == lo) & b["lower_inc"])
    ui = ((a["upper"] == hi) & a["upper_inc"]) | ((b["upper"] == hi) & b["upper_inc"])
    whole = F.struct(lo.alias("lower"), hi.alias("upper"), F.coalesce(li, F.lit(False)).alias("lower_inc"), F.coalesce(ui, F.lit(False)).alias("upper_inc"), F.lit(False).alias("empty"))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(whole)


def to_text(r: Column) -> Column:
    side = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    return F.when(r["empty"], F.lit("empty")).otherwise(
        F.concat(F.when(r["lower_inc"], "[").otherwise("("), side(r["lower"]), F.lit(","), side(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")"))
    )


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b: a does not extend to the right of b."""
    hi = b["upper"].isNull() | (a["upper"].isNotNull() & ((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (b["upper_inc"] | ~a["upper_inc"]))))
    return ~a["empty"] & ~b["empty"] & F.coalesce(hi, F.lit(False))


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b: a does not extend to the left of b."""
    lo = b["lower"].isNull() | (a["lower"].isNotNull() & ((a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & (b["lower_inc"] | ~a["lower_inc"]))))
    return ~a["empty"] & ~b["empty"] & F.coalesce(lo, F.lit(False))


def periods_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """(s1, e1) OVERLAPS (s2, e2): half-open periods in either order; an instant counts as one point."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return F.when(a == c, True).when(a < c, c < b).otherwise(a < d)
