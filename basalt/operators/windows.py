"""Window frames that Spark's windows do not spell: GROUPS, EXCLUDE and FILTER."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_group_number(df: DataFrame, partition: list[str], order: list[Column], name: str = "__g") -> DataFrame:
    """df with the number of each row's peer group, so that GROUPS frames are RANGE frames over it."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_frame(partition: list[str], start: int, end: int, name: str = "__g"):
    """GROUPS BETWEEN start AND end over a column made by with_group_number."""
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(start, end)


def exclude(df: DataFrame, partition: list[str], order: list[Column], value: str, out: str, aggregate: str, what: str) -> DataFrame:
    """aggregate(value) over the whole ordered frame up to the current peers, with EXCLUDE what.

    what: 'current row', 'group', 'ties' or 'no others'; aggregate: sum, count, avg.  The excluded
    rows' part is subtracted: no frame is ever collected.
    """
    if aggregate not in ("sum", "count", "avg") or what not in ("current row", "group", "ties", "no others"):
        raise ValueError(f"unsupported: {aggregate} EXCLUDE {what}")
    g = with_group_number(df, partition, order)
    frame = Window.partitionBy(*partition).orderBy("__g").rangeBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy(*partition, "__g")
    v = F.col(value)
    zero = F.coalesce(v, F.lit(0))
    one = F.when(v.isNotNull(), 1).otherwise(0)
    s, n = F.coalesce(F.sum(v).over(frame), F.lit(0)), F.count(v).over(frame)
    gs, gn = F.coalesce(F.sum(v).over(peers), F.lit(0)), F.count(v).over(peers)
    off = {"no others": (F.lit(0), F.lit(0)), "current row": (zero, one), "group": (gs, gn), "ties": (gs - zero, gn - one)}[what]
    s, n = s - off[0], n - off[1]
    got = {"count": n, "sum": F.when(n > 0, s), "avg": F.when(n > 0, s / n)}[aggregate]
    return g.withColumn(out, got).drop("__g")


def filtered(aggregate, value: Column, predicate: Column, window) -> Column:
    """agg(v) FILTER (WHERE p) OVER w: every row is still given out."""
    return aggregate(F.when(predicate, value)).over(window)
