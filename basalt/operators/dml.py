"""INSERT, UPDATE, DELETE, upsert and MERGE as DataFrame transforms: old snapshot in, new snapshot out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT .. SELECT: columns that rows lack take their default, else NULL."""
    defaults = defaults or {}
    cols = [(F.col(c) if c in rows.columns else defaults.get(c, F.lit(None))).cast(t).alias(c) for c, t in target.dtypes]
    return target.unionByName(rows.select(*cols))


def _unique(df: DataFrame, keys: list[str], what: str) -> Column:
    """A check that fails the job when a key occurs twice, evaluated with the row counts."""
    return F.when(F.col("__n") > 1, F.raise_error(F.lit(what))).otherwise(F.lit(1))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET update [WHERE where].

    Expressions may use t.<column> and excluded.<column>.  NULL keys never conflict.  Proposing one
    key twice with DO UPDATE is an error; with DO NOTHING one of the rows is inserted.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("__r"))
    whole = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in keys], F.lit(False))
    lone = rows.where(whole)
    one = counted.where(~whole)
    if update is not None:
        one = one.where(_unique(rows, keys, "ON CONFLICT DO UPDATE cannot affect a row twice") == 1)
    one = one.select("__r.*")
    t, e = target.alias("t"), one.alias("excluded")
    on = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys]
    if update is None:
        kept = target
    else:
        hit = F.col(f"excluded.{keys[0]}").isNotNull()
        if where is not None:
            hit = hit & F.coalesce(where, F.lit(False))
        cols = [F.when(hit, update[c]).otherwise(F.col(f"t.{c}")).cast(k).alias(c) if c in update else F.col(f"t.{c}").alias(c) for c, k in target.dtypes]
        kept = t.join(e, on, "left").select(*cols)
    new = one.join(target.select(*keys), keys, "left_anti").select(*rows.columns)
    return insert(insert(kept, new), lone)


def update_from(target: DataFrame, source: DataFrame, on: Column, key: list[str], assign: dict[str, Column]) -> DataFrame:
    """UPDATE t SET .. FROM s WHERE on, with t.<c> and s.<c> in expressions; the smallest source row wins."""
    t = target.alias("t")
    hits = t.join(source.alias("s"), on).select(*[F.col(f"t.{k}").alias(k) for k in key], F.struct(*[x.alias(c) for c, x in assign.items()]).alias("__v"))
    hits = hits.groupBy(*key).agg(F.min("__v").alias("__v"))
    cols = [F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(F.col(c)).cast(k).alias(c) if c in assign else F.col(c) for c, k in target.dtypes]
    return target.join(hits, key, "left").select(*cols)


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    """DELETE FROM t USING s WHERE on: rows without a match stay."""
    return target.alias("t").join(source.alias("s"), on, "left_anti")


@dataclass
class Merge:
    """MERGE INTO target USING source ON keys; clauses of each kind are tried in order, the first that holds wins."""

    keys: list[str]
    matched: list[tuple[str, Column | None, dict[str, Column]]] = field(default_factory=list)
    not_matched: list[tuple[Column | None, dict[str, Column]]] = field(default_factory=list)
    not_matched_by_source: list[tuple[str, Column | None, dict[str, Column]]] = field(default_factory=list)

    def when_matched_update(self, assign: dict[str, Column], guard: Column | None = None) -> Merge:
        self.matched.append(("update", guard, assign))
        return self

    def when_matched_delete(self, guard: Column | None = None) -> Merge:
        self.matched.append(("delete", guard, {}))
        return self

    def when_not_matched_insert(self, values: dict[str, Column], guard: Column | None = None) -> Merge:
        self.not_matched.append((guard, values))
        return self

    def when_not_matched_by_source_update(self, assign: dict[str, Column], guard: Column | None = None) -> Merge:
        self.not_matched_by_source.append(("update", guard, assign))
        return self

    def when_not_matched_by_source_delete(self, guard: Column | None = None) -> Merge:
        self.not_matched_by_source.append(("delete", guard, {}))
        return self

    def apply(self, target: DataFrame, source: DataFrame) -> DataFrame:
        """The merged table, by one full join on the keys; a target row with two source rows is an error."""
        one = source.withColumn("__n", F.count("*").over(Window.partitionBy(*self.keys)))
        t = target.withColumn("__t", F.lit(1)).alias("t")
        s = one.withColumn("__s", F.lit(1)).alias("s")
        j = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in self.keys], "full")
        has_t, has_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
        twice = has_t & has_s & (F.col("s.__n") > 1)
        case = F.when(twice, F.raise_error(F.lit("MERGE cannot affect a row twice")).cast("int"))
        holds = lambda g: F.lit(True) if g is None else F.coalesce(g, F.lit(False))
        actions: list[tuple[str, dict[str, Column]]] = []
        for which, clauses in ((has_t & has_s, self.matched), (has_t & ~has_s, self.not_matched_by_source)):
            for kind, guard, assign in clauses:
                case = case.when(which & holds(guard), F.lit(len(actions)))
                actions.append((kind, assign))
        for guard, values in self.not_matched:
            case = case.when(~has_t & has_s & holds(guard), F.lit(len(actions)))
            actions.append(("insert", values))
        case = case.when(has_t, F.lit(-1))
        j = j.withColumn("__a", case).where("__a IS NOT NULL")
        gone = [k for k, (kind, _) in enumerate(actions) if kind == "delete"]
        j = j.where(~F.col("__a").isin(gone)) if gone else j
        cols = []
        for c, k in target.dtypes:
            x = F.when(F.col("__a") == -1, F.col(f"t.{c}"))
            for n, (kind, values) in enumerate(actions):
                if kind != "delete":
                    x = x.when(F.col("__a") == n, values.get(c, F.lit(None) if kind == "insert" else F.col(f"t.{c}")).cast(k))
            cols.append(x.alias(c))
        return j.select(*cols)
