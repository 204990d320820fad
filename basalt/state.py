"""What a session of the dialect remembers: variables, prepared statements, enum and domain types, policies, procedures."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialect


@dataclass
class Domain:
    """CREATE DOMAIN name AS base [NOT NULL] [CHECK (..)]; values checks a column, NULL passes a check."""

    base: str
    check: Callable[[Column], Column] | None = None
    not_null: bool = False

    def values(self, c: Column) -> Column:
        v = c.cast(self.base)
        if self.not_null:
            v = F.when(v.isNull(), F.raise_error(F.lit("domain does not allow null values")).cast(self.base)).otherwise(v)
        if self.check:
            v = F.when(~F.coalesce(self.check(v), F.lit(True)), F.raise_error(F.lit("value violates domain check")).cast(self.base)).otherwise(v)
        return v


def enum_type(*labels: str) -> Domain:
    """CREATE TYPE name AS ENUM (..)."""
    return Domain("string", lambda c: c.isin(*labels))


def enum_rank(c: Column, *labels: str) -> Column:
    """The place of a label: enums order as they were declared."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), c)


@dataclass
class Session:
    spark: SparkSession
    user: str = "owner"
    variables: dict[str, str] = field(default_factory=dict)
    prepared: dict[str, str] = field(default_factory=dict)
    policies: dict[str, list[tuple[bool, str]]] = field(default_factory=dict)
    procedures: dict[str, Callable] = field(default_factory=dict)
    depth: int = 0

    def set(self, name: str, value: str) -> None:
        self.variables[name.lower()] = value

    def reset(self, name: str) -> None:
        self.variables.pop(name.lower(), None)

    def show(self, name: str) -> str | None:
        return self.variables.get(name.lower())

    def sql(self, text: str, *args) -> DataFrame:
        """One statement; $1, $2 .. are arguments."""
        marked = re.sub(r"\$(\d+)", lambda m: f":p{m[1]}", text)
        spark_sql = dialect.translate(marked).replace(": p", ":p")
        return dialect.settle(self.spark, spark_sql, {f"p{k}": a for k, a in enumerate(args, 1)})

    def prepare(self, name: str, text: str) -> None:
        if name in self.prepared:
            raise ValueError(f"prepared statement {name!r} already exists")
        self.prepared[name] = text

    def execute(self, name: str, *args) -> DataFrame:
        return self.sql(self.prepared[name], *args)

    def deallocate(self, name: str) -> None:
        del self.prepared[name]

    def explain(self, text: str) -> str:
        """The formatted plan of a statement."""
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def add_policy(self, table: str, predicate: str, restrictive: bool = False) -> None:
        self.policies.setdefault(table, []).append((restrictive, predicate))

    def visible(self, table: str) -> DataFrame:
        """A table's rows under its policies: any permissive one and all restrictive ones; none at all without a permissive one."""
        df, rules = self.spark.table(table), self.policies.get(table, [])
        if not rules:
            return df
        open_ = [p for r, p in rules if not r]
        df = df.where(" OR ".join(f"({p})" for p in open_)) if open_ else df.limit(0)
        for r, p in rules:
            if r:
                df = df.where(p)
        return df

    def create_procedure(self, name: str, body: Callable) -> None:
        self.procedures[name.lower()] = body

    def call(self, name: str, *args):
        if self.depth >= 64:
            raise RecursionError("procedure nesting is too deep")
        self.depth += 1
        try:
            return self.procedures[name.lower()](self, *args)
        finally:
            self.depth -= 1
