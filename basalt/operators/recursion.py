"""Recursive queries to a fixpoint, with UNION and UNION ALL semantics."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_root

#: Rounds after which a recursion that does not end is an error.
LIMIT = 10_000
#: Rounds after which the known rows are written as one table again.
COMPACT = 16


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = LIMIT) -> DataFrame:
    """WITH RECURSIVE seed UNION [ALL] step(working table).

    Each round sees the rows that the round before added.  With distinct=True rows that are known
    already are dropped by an anti join, so cycles end.  Rounds are checkpointed to the shared
    folder: lineage stays short and a lost executor repeats one round.
    """
    spark = seed.sparkSession
    scratch_root(spark)
    columns = seed.columns
    fresh = (seed.distinct() if distinct else seed).checkpoint()
    known = fresh
    for k in range(1, limit + 1):
        new = step(fresh).toDF(*columns)
        if distinct:
            new = new.distinct().alias("n")
            same = reduce(Column.__and__, [F.col(f"n.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in columns])
            new = new.join(known.alias("k"), same, "left_anti")
        fresh = new.checkpoint()
        if fresh.isEmpty():
            return known
        known = known.union(fresh)
        if k % COMPACT == 0:
            known = known.checkpoint()
    raise RuntimeError(f"recursion did not end within {limit} rounds")
