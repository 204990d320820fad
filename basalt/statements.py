"""Statements that change tables or the session, as SQL text: a Database runs them and queries alike.

A table is a list of Parquet parts in the shared scratch folder with a temporary view of its name.  INSERT
writes one part; UPDATE and DELETE write what they change and what they leave as new parts, so a statement that
fails leaves the table as it was, and ROLLBACK puts the old lists of parts back.  Constraints are checked on
the new parts before the table changes; uniqueness, on the whole table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dialect, macros
from .operators.constraints import Table
from .operators_sql import _find, _group, _split, rewrite
from .sources.scratch import scratch_root
from .state import Session

HIDDEN = ("__part", "__row")


@dataclass
class Stored:
    """Columns (name, type, default as SQL, generated as SQL), constraints and parts of a table."""

    columns: list[tuple[str, str, str | None, str | None]]
    rules: Table = field(default_factory=Table)
    parts: list[str] = field(default_factory=list)
    parents: list[tuple[list[str], str, list[str]]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]


def _name(t: str) -> str:
    return t.strip("`")


class Database:
    """Runs statements of the dialect; queries go to dialect.sql."""

    def __init__(self, spark: SparkSession):
        self.spark, self.session = spark, Session(spark)
        self.tables: dict[str, Stored] = {}
        self.saved: list[tuple[str | None, dict[str, list[str]]]] = []

    # tables

    def _read(self, name: str, hidden: bool = False) -> DataFrame:
        t = self.tables[name]
        schema = ", ".join(f"`{c}` {k}" for c, k, *_ in t.columns) + ", __part string, __row bigint"
        df = self.spark.read.schema(schema).parquet(*t.parts) if t.parts else self.spark.createDataFrame([], schema)
        return df if hidden else df.select(*t.names)

    def _show(self, name: str) -> None:
        self._read(name).createOrReplaceTempView(name)

    def _write(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        path = f"{scratch_root(self.spark)}/basalt-tables/{part}"
        df.withColumn("__part", F.lit(part)).withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
        return path

    def _replace(self, name: str, parts: list[str], new: str | None) -> DataFrame | None:
        """Let the table consist of parts, of which `new` is to be checked; on a violation all stays as it was."""
        t = self.tables[name]
        before, t.parts = t.parts, parts
        try:
            if new:
                fresh = self.spark.read.parquet(new)
                keys = Table(unique=t.rules.unique + ([t.rules.primary_key] if t.rules.primary_key else []))
                foreign = [(own, self._read(parent), theirs) for own, parent, theirs in t.parents]
                Table(not_null=[*t.rules.not_null, *t.rules.primary_key], checks=t.rules.checks, foreign_keys=foreign).check(fresh)
                keys.check(self._read(name))
            for other, o in self.tables.items():
                for own, parent, theirs in o.parents if before != parts else ():
                    if parent == name:
                        Table(foreign_keys=[(own, self._read(name), theirs)]).check(self._read(other))
        except Exception:
            t.parts = before
            raise
        self._show(name)
        return None

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the table's column types, defaults for absent columns, and generated columns."""
        t = self.tables[name]
        plain = [F.col(f"`{c}`").cast(k).alias(c) if c in rows.columns else F.expr(d or "NULL").cast(k).alias(c) for c, k, d, g in t.columns if not g]
        out = rows.select(*plain)
        for c, k, _, g in t.columns:
            if g:
                out = out.withColumn(c, F.expr(g).cast(k))
        return out.select(*t.names)

    def _create(self, tokens: list[str]) -> None:
        at = 2
        quiet = [t.upper() for t in tokens[at : at + 3]] == ["IF", "NOT", "EXISTS"]
        at += 3 * quiet
        name = _name(tokens[at])
        if name in self.tables:
            if quiet:
                return
            raise ValueError(f"relation {name!r} already exists")
        if tokens[at + 1].upper() == "AS":
            df = dialect.settle(self.spark, rewrite(tokens[at + 2 :]))
            t = self.tables[name] = Stored([(c, k, None, None) for c, k in df.dtypes])
            t.parts = [self._write(df)]
            return self._show(name)
        end = _group(tokens, at + 1)
        t = Stored([])
        for item in _split(tokens[at + 2 : end]):
            words = [x.upper() for x in item]
            if words[0] == "CONSTRAINT":
                item, words = item[2:], words[2:]
            listed = lambda k: [_name(x) for x in item[k + 1 : _group(item, k)] if x != ","]  # noqa: E731, B023
            if words[:2] == ["PRIMARY", "KEY"]:
                t.rules.primary_key = listed(2)
            elif words[0] == "UNIQUE":
                t.rules.unique.append(listed(1))
            elif words[0] == "CHECK":
                t.rules.checks[f"{name}_check{len(t.rules.checks)}"] = F.expr(rewrite(item[1:]))
            elif words[:2] == ["FOREIGN", "KEY"]:
                close = _group(item, 2)
                t.parents.append((listed(2), _name(item[close + 2]), listed(close + 3)))
            else:
                self._column(t, name, item, words)
        self.tables[name] = t
        self._show(name)

    def _column(self, t: Stored, table: str, item: list[str], words: list[str]) -> None:
        c, kind, k = _name(item[0]), dialect._TYPES.get(words[1], words[1]), 2
        if k < len(item) and item[k] == "(":
            end = _group(item, k)
            if kind not in ("STRING",):
                kind += "".join(item[k : end + 1])
            k = end + 1
        elif kind == "DECIMAL":
            kind = "DECIMAL(38, 18)"
        default = generated = None
        while k < len(item):
            if words[k : k + 2] == ["NOT", "NULL"]:
                t.rules.not_null.append(c)
                k += 2
            elif words[k : k + 2] == ["PRIMARY", "KEY"]:
                t.rules.primary_key, k = [c], k + 2
            elif words[k] == "UNIQUE":
                t.rules.unique.append([c])
                k += 1
            elif words[k] == "CHECK":
                end = _group(item, k + 1)
                t.rules.checks[f"{table}_{c}_check"] = F.expr(rewrite(item[k + 1 : end + 1]))
                k = end + 1
            elif words[k : k + 3] == ["GENERATED", "ALWAYS", "AS"]:
                end = _group(item, k + 3)
                generated, k = rewrite(item[k + 3 : end + 1]), end + 1 + (words[end + 1 : end + 2] == ["STORED"])
            elif words[k] == "DEFAULT":
                stop = next((j for j in range(k + 1, len(item)) if words[j] in ("NOT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES")), len(item))
                default, k = rewrite(item[k + 1 : stop]), stop
            elif words[k] == "REFERENCES":
                t.parents.append(([c], _name(item[k + 1]), [_name(item[k + 3])]))
                k += 5
            else:
                raise dialect.UnsupportedSyntax(f"column option {item[k]}")
        t.columns.append((c, kind, default, generated))

    # writes

    def _returning(self, tokens: list[str], rows: DataFrame, name: str) -> DataFrame | None:
        if not tokens:
            return None
        view = f"__returning_{uuid.uuid4().hex}"
        rows.select(*self.tables[name].names).createOrReplaceTempView(view)
        out = dialect.settle(self.spark, f"SELECT {rewrite(tokens)} FROM {view} AS {name}")
        self.spark.catalog.dropTempView(view)
        return out

    def _insert(self, tokens: list[str]) -> DataFrame | None:
        name, at = _name(tokens[2]), 3
        t = self.tables[name]
        names = [c for c, _, _, g in t.columns if not g]
        if tokens[at] == "(" and tokens[at + 1].upper() not in ("SELECT", "WITH"):
            end = _group(tokens, at)
            names, at = [_name(x) for x in tokens[at + 1 : end] if x != ","], end + 1
            if unknown := [c for c in names if c not in t.names]:
                raise ValueError(f"column {unknown[0]!r} does not exist")
            if made := [c for c, _, _, g in t.columns if g and c in names]:
                raise ValueError(f"cannot insert into generated column {made[0]!r}")
        body, returning = self._cut(tokens[at:], "RETURNING")
        body, conflict = self._cut(body, "ON", "CONFLICT")
        if [x.upper() for x in body] == ["DEFAULT", "VALUES"]:
            rows = self.spark.range(1).drop("id")
        else:
            rows = dialect.settle(self.spark, rewrite(dialect._orders(dialect._words(body))))
            if len(rows.columns) > len(names):
                raise ValueError("INSERT has more expressions than target columns")
            rows = rows.toDF(*names[: len(rows.columns)])
        rows = self._typed(name, rows)
        if not conflict:
            part = self._write(rows)
            self._replace(name, [*t.parts, part], part)
            return self._returning(returning, self.spark.read.parquet(part), name)
        return self._upsert(name, rows, conflict, returning)

    def _upsert(self, name: str, rows: DataFrame, conflict: list[str], returning: list[str]) -> DataFrame | None:
        t = self.tables[name]
        keys = t.rules.primary_key
        if conflict[0] == "(":
            end = _group(conflict, 0)
            keys, conflict = [_name(x) for x in conflict[1:end] if x != ","], conflict[end + 1 :]
        rows = self.spark.read.parquet(self._write(rows))
        same = " AND ".join(f"t.`{k}` = excluded.`{k}`" for k in keys)
        whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "false"
        ordered = F.row_number().over(Window.partitionBy(*keys).orderBy("__row"))
        numbered = rows.withColumn("__n", F.when(F.expr(whole), ordered).otherwise(1))
        update = [x.upper() for x in conflict[:3]] == ["DO", "UPDATE", "SET"]
        if update and numbered.where("__n > 1").limit(1).count():
            raise ValueError("ON CONFLICT DO UPDATE command cannot affect row a second time")
        one = numbered.where("__n = 1").drop("__n")
        old = self._read(name, hidden=True)
        new = one.join(old.select(*keys), keys, "left_anti").select(*t.names)
        if not update:
            part = self._write(new)
            self._replace(name, [*t.parts, part], part)
            return self._returning(returning, self.spark.read.parquet(part), name)
        sets, where = self._cut(conflict[3:], "WHERE")
        hits = old.alias(name).join(one.drop(*HIDDEN).alias("excluded"), F.expr(same.replace("t.", f"{name}.")), "inner")
        if where:
            hits = hits.where(F.expr(rewrite(where)))
        part = self._write(self._assigned(name, hits, sets).unionByName(new))
        touched = hits.select(*[F.col(f"{name}.{c}").alias(c) for c in HIDDEN])
        left = self._write(old.join(touched, list(HIDDEN), "left_anti").select(*t.names))
        self._replace(name, [left, part], part)
        return self._returning(returning, self.spark.read.parquet(part), name)

    def _assigned(self, name: str, rows: DataFrame, sets: list[str], alias: str | None = None) -> DataFrame:
        """The table's columns of joined rows with SET applied; generated columns are made anew."""
        t, to = self.tables[name], {}
        for item in _split(sets):
            c = _name(item[0])
            if c not in t.names:
                raise ValueError(f"column {c!r} does not exist")
            default = next(d for n, _, d, _ in t.columns if n == c)
            to[c] = (default or "NULL") if [x.upper() for x in item[2:]] == ["DEFAULT"] else rewrite(item[2:])
        return self._typed(name, rows.select(*[F.expr(to[c]).alias(c) if c in to else F.col(f"{alias or name}.`{c}`").alias(c) for c in t.names]))

    def _target(self, tokens: list[str]) -> tuple[str, str, list[str]]:
        name, rest = _name(tokens[0]), tokens[1:]
        if rest and rest[0].upper() == "AS":
            rest = rest[1:]
        if rest and rest[0].upper() not in ("SET", "FROM", "USING", "WHERE", "RETURNING"):
            return name, _name(rest[0]), rest[1:]
        return name, name, rest

    @staticmethod
    def _cut(tokens: list[str], *words: str) -> tuple[list[str], list[str]]:
        at = _find(tokens, *words)
        return (tokens, []) if at < 0 else (tokens[:at], tokens[at + len(words) :])

    def _change(self, tokens: list[str], update: bool) -> DataFrame | None:
        """UPDATE t SET .. [FROM s] or DELETE FROM t [USING s]; of several matches of a row, the one of least new values counts."""
        name, alias, rest = self._target(tokens[1:] if update else tokens[2:])
        rest, returning = self._cut(rest, "RETURNING")
        rest, where = self._cut(rest, "WHERE")
        rest, source = self._cut(rest, "FROM" if update else "USING")
        sets = rest[1:] if update else []
        t, old = self.tables[name], self._read(name, hidden=True)
        test = rewrite(where) if where else "true"
        rows = old.alias(alias)
        if source:
            view = f"__target_{uuid.uuid4().hex}"
            old.createOrReplaceTempView(view)
            rows = self.spark.sql(f"SELECT * FROM {view} AS {alias}, {rewrite(source)} WHERE {test}")
            cols = ", ".join(f"{alias}.`{c}`" for c in (*HIDDEN, *t.names))
            to = {_name(i[0]): rewrite(i[2:]) for i in _split(sets)}
            made = ", ".join(f"{to[c]} AS `__new_{c}`" for c in to)
            hits = self.spark.sql(f"SELECT {cols}{', ' + made if made else ''} FROM {view} AS {alias}, {rewrite(source)} WHERE {test}")
            hits = hits.groupBy(*HIDDEN).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in [*[f"__new_{c}" for c in to], *t.names]])).alias("__v")).select(*HIDDEN, "__v.*")
            changed = self._typed(name, hits.select(*[F.col(f"`__new_{c}`" if c in to else f"`{c}`").alias(c) for c in t.names]))
        else:
            hits = rows.where(F.expr(test))
            changed = self._assigned(name, hits, sets, alias) if update else hits.select(*t.names)
        part = self._write(changed)
        left = self._write(old.join(hits.select(*HIDDEN), list(HIDDEN), "left_anti").select(*t.names) if source else rows.where(~F.coalesce(F.expr(test), F.lit(False))).select(*t.names))
        self._replace(name, [left, part] if update else [left], part if update else None)
        return self._returning(returning, self.spark.read.parquet(part), name)

    # everything

    def run(self, text: str) -> DataFrame | None:
        """One statement; a query or a RETURNING clause gives rows, anything else None."""
        tokens = [t for t in dialect.tokenize(text) if t != ";"]
        words = [t.upper() for t in tokens[:4]]
        if words[:2] in (["CREATE", "TABLE"], ["CREATE", "TEMP"], ["CREATE", "TEMPORARY"]):
            return self._create(tokens if words[1] == "TABLE" else tokens[:1] + tokens[2:])
        if words[:2] in (["DROP", "TABLE"], ["DROP", "VIEW"]):
            name = _name(tokens[-1])
            if self.tables.pop(name, None) is None and words[1] == "TABLE" and words[2:4] != ["IF", "EXISTS"]:
                raise ValueError(f"table {name!r} does not exist")
            self.spark.catalog.dropTempView(name)
        elif words[0] == "TRUNCATE":
            self._replace(_name(tokens[1 + (words[1] == "TABLE")]), [], None)
        elif words[:2] == ["CREATE", "VIEW"]:
            dialect.settle(self.spark, dialect.translate(text[text.upper().index(" AS ") + 4 :])).createOrReplaceTempView(_name(tokens[2]))
        elif words[0] == "INSERT":
            return self._insert(tokens)
        elif words[0] in ("UPDATE", "DELETE"):
            return self._change(dialect._words(tokens), words[0] == "UPDATE")
        elif words[0] in ("BEGIN", "START", "SAVEPOINT"):
            self.saved.append((tokens[1] if words[0] == "SAVEPOINT" else None, {n: list(t.parts) for n, t in self.tables.items()}))
        elif words[0] in ("COMMIT", "END"):
            self.saved.clear()
        elif words[0] == "ROLLBACK":
            self._rollback(tokens[-1] if words[1:2] == ["TO"] else None)
        elif words[0] == "PREPARE":
            self.session.prepare(_name(tokens[1]), text[text.upper().index(" AS ") + 4 :])
        elif words[0] == "EXECUTE":
            args = [] if len(tokens) < 3 else [macros.constant("".join(a)) for a in _split(tokens[3:-1])]
            return self.session.execute(_name(tokens[1]), *args)
        elif words[0] == "DEALLOCATE":
            self.session.deallocate(_name(tokens[-1]))
        elif words[0] == "SET":
            self.session.set(tokens[1], " ".join(tokens[3:]).strip("'"))
        elif words[0] == "RESET":
            self.session.reset(tokens[1])
        elif words[0] == "SHOW":
            return self.spark.createDataFrame([(self.session.show(tokens[1]),)], f"`{tokens[1]}` string")
        elif words[0] == "EXPLAIN":
            return self.spark.createDataFrame([(x,) for x in self.session.explain(text[text.upper().index("EXPLAIN") + 7 :]).split("\n")], "`QUERY PLAN` string")
        else:
            return dialect.sql(self.spark, text)
        return None

    def _rollback(self, to: str | None) -> None:
        while self.saved:
            name, parts = self.saved[-1]
            if to is None and len(self.saved) > 1 or to is not None and name != to:
                self.saved.pop()
                continue
            for n, t in self.tables.items():
                t.parts = list(parts.get(n, []))
                self._show(n)
            if to is None:
                self.saved.pop()
            return
        raise ValueError(f"savepoint {to!r} does not exist" if to else "there is no transaction in progress")
