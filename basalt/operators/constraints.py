"""Table state that the dialect keeps beside rows: defaults, generated columns, sequences, constraints, views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Sequence:
    """A driver-side sequence; a batch of rows takes a block of values at once."""

    def __init__(self, start: int = 1, increment: int = 1):
        if increment == 0:
            raise ValueError("INCREMENT must not be zero")
        self.increment, self.next, self.last = increment, start, None

    def nextval(self) -> int:
        self.last, self.next = self.next, self.next + self.increment
        return self.last

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("currval is not yet defined in this session")
        return self.last

    def setval(self, value: int, is_called: bool = True) -> int:
        self.next = value + self.increment if is_called else value
        if is_called:
            self.last = value
        return value

    def number(self, rows: DataFrame, column: str) -> DataFrame:
        """Consecutive values for the rows of a frame: partition counts first, then offsets; no global sort."""
        part = rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
        part = part.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else part.cache()
        counts = sorted((r["__p"], r["count"]) for r in part.groupBy("__p").count().collect())  # a row for each partition
        at, offsets = self.next, {}
        for p, n in counts:
            offsets[p] = at
            at += n * self.increment
        if at != self.next:
            self.last, self.next = at - self.increment, at
        base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map(F.lit(0), F.lit(0))
        within = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
        return part.withColumn(column, (base[F.col("__p")] + within * self.increment).cast("bigint")).drop("__p", "__i")


@dataclass
class Table:
    """Constraints of a table; check() raises on the first violation that the rows hold."""

    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, Column] = field(default_factory=dict)
    foreign_keys: list[tuple[list[str], DataFrame, list[str]]] = field(default_factory=list)
    generated: dict[str, Column] = field(default_factory=dict)

    def complete(self, rows: DataFrame) -> DataFrame:
        """Rows with their generated columns."""
        for c, x in self.generated.items():
            rows = rows.withColumn(c, x)
        return rows

    def check(self, rows: DataFrame) -> DataFrame:
        found = [*self.not_null, *self.primary_key]
        if found and rows.where(" OR ".join(f"`{c}` IS NULL" for c in found)).limit(1).count():
            raise ValueError(f"null value violates not-null constraint on {found}")
        for name, rule in self.checks.items():  # NULL passes
            if rows.where(~F.coalesce(rule, F.lit(True))).limit(1).count():
                raise ValueError(f"new row violates check constraint {name!r}")
        for key in ([self.primary_key] if self.primary_key else []) + self.unique:
            whole = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
            if whole.groupBy(*key).count().where("count > 1").limit(1).count():
                raise ValueError(f"duplicate key value violates unique constraint on {key}")
        for own, other, theirs in self.foreign_keys:
            held = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in own)).alias("c")
            on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(own, theirs)]
            if held.join(other.alias("p"), on, "left_anti").limit(1).count():
                raise ValueError(f"insert or update violates foreign key constraint on {own}")
        return rows

    def delete_parents(self, rows: DataFrame, parents: DataFrame, own: list[str], theirs: list[str], action: str = "NO ACTION") -> DataFrame:
        """This table's rows after `parents` were deleted: NO ACTION, CASCADE or SET NULL."""
        on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(own, theirs)]
        c, p = rows.alias("c"), parents.select(*theirs).distinct().alias("p")
        if action == "CASCADE":
            return c.join(p, on, "left_anti")
        if action == "SET NULL":
            hit = F.col(f"p.{theirs[0]}").isNotNull()
            return c.join(p, on, "left").select(*[F.when(~hit, F.col(f"c.{x}")).alias(x) if x in own else F.col(f"c.{x}") for x in rows.columns])
        if c.join(p, on, "left_semi").limit(1).count():
            raise ValueError(f"delete violates foreign key constraint on {own}")
        return rows


@dataclass
class MaterializedView:
    """Rows of a query that are written once and again on refresh()."""

    query: Callable[[], DataFrame]
    path: str

    def refresh(self) -> DataFrame:
        import uuid

        self.current = f"{self.path}/v-{uuid.uuid4().hex}"
        self.query().write.parquet(self.current)
        return self.read()

    def read(self) -> DataFrame:
        from pyspark.sql import SparkSession

        if not hasattr(self, "current"):
            return self.refresh()
        return SparkSession.getActiveSession().read.parquet(self.current)
