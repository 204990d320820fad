"""JSON functions over text in canonical form: object keys by length, then bytes; the last of equal keys wins.

A function parses each distinct document of an Arrow batch once.  jsonpath: $, .key, ."key", .*, [n], [last],
[*], ?(..) filters with comparisons, &&, ||, !, exists(..), and .size(), .type(), .double(), .abs().
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .udfs import bound


_DECODE = json.JSONDecoder(parse_float=Decimal).decode  # json.loads makes a decoder for each call
_QUOTE = json.encoder.encode_basestring


def loads(s: str):
    return _DECODE(s) if isinstance(s, str) and not s.startswith("\ufeff") else json.loads(s, parse_float=Decimal)


def dumps(v, indent: int | None = None, level: int = 0) -> str:
    if isinstance(v, str):
        return _QUOTE(v)
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    if isinstance(v, int):
        return int.__repr__(v)
    if isinstance(v, (float, Decimal)):
        return format(v, "f") if isinstance(v, Decimal) else json.dumps(v)
    pad, close = ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level) if indent else ("", "")
    sep = "," + pad if indent else ", "
    if isinstance(v, list):
        return "[" + pad + sep.join(dumps(x, indent, level + 1) for x in v) + close + "]" if v else "[]"
    items = sorted(v.items(), key=lambda e: (len(e[0].encode()), e[0].encode()))
    return "{" + pad + sep.join(f"{_QUOTE(k)}: {dumps(x, indent, level + 1)}" for k, x in items) + close + "}" if v else "{}"


def kind(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, Decimal)) else {str: "string", list: "array", dict: "object"}[type(v)]


def text_of(v):
    """The ->> form: strings bare, JSON null as NULL."""
    return None if v is None else v if isinstance(v, str) else dumps(v)


class _GONE:
    """The mark of what is not there; a class, since workers get an object as a copy and a class by its name."""


def walk(v, path: list[str]):
    for p in path:
        if isinstance(v, dict):
            v = v.get(p, _GONE)
        elif isinstance(v, list) and re.fullmatch(r"-?\d+", p):
            v = v[int(p)] if -len(v) <= int(p) < len(v) else _GONE
        else:
            return _GONE
        if v is _GONE:
            return _GONE
    return v


def put(v, path: list[str], new, create: bool = True, insert: str | None = None):
    """v with new at path: replaced, created, or (insert = 'before' | 'after') inserted."""
    if not path:
        return v
    head, rest = path[0], path[1:]
    if isinstance(v, dict):
        if rest:
            return v | {head: put(v[head], rest, new, create, insert)} if head in v else v
        if insert and head in v:
            raise ValueError("cannot replace existing key")
        return v | {head: new} if head in v or create else v
    if isinstance(v, list):
        if not re.fullmatch(r"-?\d+", head):
            raise ValueError(f"path element is not an integer: {head!r}")
        k = int(head)
        at = k + len(v) if k < 0 else k
        if rest:
            return [*v[:at], put(v[at], rest, new, create, insert), *v[at + 1 :]] if 0 <= at < len(v) else v
        if insert:
            at = min(max(at, 0), len(v)) + (insert == "after" and 0 <= at < len(v))
            return [*v[:at], new, *v[at:]]
        if 0 <= at < len(v):
            return [*v[:at], new, *v[at + 1 :]]
        return ([new, *v] if at < 0 else [*v, new]) if create else v
    return v


def strip_nulls(v):
    if isinstance(v, dict):
        return {k: strip_nulls(x) for k, x in v.items() if x is not None}
    return [strip_nulls(x) for x in v] if isinstance(v, list) else v


# jsonpath: compiled to a function from a document to the list of matches.

_TOKEN = re.compile(r"""\s*(\$|@|\.\*|\.|\[|\]|\(|\)|\?|\*|&&|\|\||!=|<>|==|<=|>=|<|>|!|,|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|[A-Za-z_]\w*)""")


class _Path:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        for mode in ("lax ", "strict "):
            text = text.removeprefix(mode)
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"syntax error in jsonpath: {text!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0
        self.run = self.either()
        if self.at != len(self.tokens):
            raise ValueError(f"syntax error in jsonpath: {text!r}")

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *want):
        t = self.peek()
        if t is None or want and t not in want:
            return None
        self.at += 1
        return t

    def need(self, want):
        if not self.take(want):
            raise ValueError(f"jsonpath: expected {want!r}")

    def either(self):
        a = self.both()
        while self.take("||"):
            a = (lambda x, y: lambda root, cur: [bool(x(root, cur) == [True]) or bool(y(root, cur) == [True])])(a, self.both())
        return a

    def both(self):
        a = self.no()
        while self.take("&&"):
            a = (lambda x, y: lambda root, cur: [bool(x(root, cur) == [True]) and bool(y(root, cur) == [True])])(a, self.no())
        return a

    def no(self):
        if self.take("!"):
            x = self.no()
            return lambda root, cur: [x(root, cur) != [True]]
        return self.compare()

    def compare(self):
        a = self.value()
        if op := self.take("==", "!=", "<>", "<", "<=", ">", ">="):
            b = self.value()

            def test(x, y) -> bool:
                if kind(x) != kind(y):
                    return op in ("!=", "<>") and (x is None or y is None)
                if op in ("==", "!=", "<>"):
                    return (x == y) == (op == "==")
                if isinstance(x, (dict, list)) or x is None:
                    return False
                return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

            return lambda root, cur: [any(test(x, y) for x in a(root, cur) for y in b(root, cur))]
        return a

    def value(self):
        t = self.take()
        if t == "(":
            x = self.either()
            self.need(")")
            return self.steps(x)
        if t == "exists":
            self.need("(")
            x = self.either()
            self.need(")")
            return lambda root, cur: [bool(x(root, cur))]
        if t in ("$", "@"):
            return self.steps((lambda root, cur: [root]) if t == "$" else (lambda root, cur: [cur]))
        if t in ("true", "false", "null"):
            return lambda root, cur, v={"true": True, "false": False, "null": None}[t]: [v]
        if t and (t[0] == '"' or t[0] == "-" or t[0].isdigit()):
            return lambda root, cur, v=loads(t): [v]
        raise ValueError(f"jsonpath: unexpected {t!r}")

    def steps(self, base):
        while True:
            if self.take(".*"):
                base = (lambda b: lambda r, c: [y for x in _spread(b(r, c)) if isinstance(x, dict) for y in x.values()])(base)
            elif self.take("."):
                name = self.take()
                if self.take("("):
                    self.need(")")
                    base = (lambda b, n: lambda r, c: [_method(n, x) for x in b(r, c)])(base, name)
                else:
                    key = loads(name) if name[0] == '"' else name
                    base = (lambda b, k: lambda r, c: [x[k] for x in _spread(b(r, c)) if isinstance(x, dict) and k in x])(base, key)
            elif self.take("["):
                if self.take("*"):
                    base = (lambda b: lambda r, c: [y for x in b(r, c) for y in (x if isinstance(x, list) else [x])])(base)
                else:
                    n = self.take()
                    base = (lambda b, n: lambda r, c: [y for x in b(r, c) for y in _at(x, n)])(base, n)
                self.need("]")
            elif self.take("?"):
                self.need("(")
                cond = self.either()
                self.need(")")
                base = (lambda b, f: lambda r, c: [x for x in _spread(b(r, c)) if f(r, x) == [True]])(base, cond)
            else:
                return base


def _spread(values: list) -> list:
    """Lax mode: arrays open before a member or filter step."""
    return [y for x in values for y in (x if isinstance(x, list) else [x])]


def _at(x, n: str) -> list:
    x = x if isinstance(x, list) else [x]
    k = len(x) - 1 if n == "last" else int(n)
    return [x[k]] if 0 <= k < len(x) else []


def _method(name: str, x):
    if name == "size":
        return len(x) if isinstance(x, list) else 1
    if name == "type":
        return kind(x)
    if name == "double":
        return Decimal(str(x))
    if name == "abs":
        return abs(x)
    raise ValueError(f"jsonpath: unknown method {name}()")


@lru_cache(1000)
def path_of(text: str):
    run = _Path(text).run
    return lambda doc: run(doc, doc)


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW["array<struct<key:string,value:string>>"] = pa.list_(pa.struct({"key": pa.string(), "value": pa.string()}))


def _distinct(s: pa.Array, f, kind_: str) -> pa.Array:
    """f of every value, worked out once for each distinct one; NULL stays NULL, and what f returns as _GONE is NULL."""
    d = s.dictionary_encode()
    found = [None if v is None or (o := f(loads(v))) is _GONE else o for v in d.dictionary.to_pylist()]
    return pa.array(found, _ARROW[kind_]).take(d.indices)


def _batch(f, kind_: str):
    """A NULL-strict Column function of JSON text; what f returns as _GONE is NULL."""

    @F.arrow_udf(kind_)
    def run(s: pa.Array) -> pa.Array:
        return _distinct(s, f, kind_)

    return bound(run)


def json_typeof(c):
    return _batch(kind, "string")(c)


def canonical(c):
    return _batch(dumps, "string")(c)


def json_array_length(c):
    return _batch(lambda v: len(v) if isinstance(v, list) else _GONE, "int")(c)


def json_extract_path(c, *path: str):
    return _batch(lambda v: _GONE if (x := walk(v, list(path))) is _GONE else dumps(x), "string")(c)


def json_extract_path_text(c, *path: str):
    return _batch(lambda v: _GONE if (x := walk(v, list(path))) is _GONE else text_of(x), "string")(c)


def json_set(c, path: list[str], new: str, create: bool = True):
    value = loads(new)
    return _batch(lambda v: dumps(put(v, path, value, create)), "string")(c)


def json_set_lax(c, path: list[str], new: str | None, create: bool = True, treatment: str = "use_json_null"):
    if new is not None:
        return json_set(c, path, new, create)
    if treatment == "use_json_null":
        return json_set(c, path, "null", create)
    if treatment == "return_target":
        return canonical(c)
    if treatment == "delete_key":
        return _batch(lambda v: dumps(_without(v, path)), "string")(c)
    raise ValueError("null_value_treatment must be use_json_null, return_target or delete_key")


def _without(v, path: list[str]):
    if not path or not isinstance(v, (dict, list)):
        return v
    inner = walk(v, path[:-1])
    if isinstance(inner, dict):
        inner = {k: x for k, x in inner.items() if k != path[-1]}
    elif isinstance(inner, list) and re.fullmatch(r"-?\d+", path[-1]):
        inner = [x for k, x in enumerate(inner) if k not in (int(path[-1]), int(path[-1]) + len(inner))]
    else:
        return v
    return put(v, path[:-1], inner) if path[:-1] else inner


def json_insert(c, path: list[str], new: str, after: bool = False):
    value = loads(new)
    return _batch(lambda v: dumps(put(v, path, value, True, "after" if after else "before")), "string")(c)


def json_delete_path(c, path: list[str]):
    """The #- operator."""
    return _batch(lambda v: dumps(_without(v, path)), "string")(c)


def json_strip_nulls(c):
    return _batch(lambda v: dumps(strip_nulls(v)), "string")(c)


def json_pretty(c):
    return _batch(lambda v: dumps(v, 4), "string")(c)


def json_exists(c, key: str):
    return _batch(lambda v: key in v if isinstance(v, (dict, list)) else v == key, "boolean")(c)


def json_path_exists(c, path: str):
    return _batch(lambda v: bool(path_of(path)(v)), "boolean")(c)


def json_path_match(c, path: str):
    return _batch(lambda v: r[0] if len(r := path_of(path)(v)) == 1 and isinstance(r[0], bool) else _GONE, "boolean")(c)


def json_path_query_first(c, path: str):
    return _batch(lambda v: dumps(r[0]) if (r := path_of(path)(v)) else _GONE, "string")(c)


def json_path_query_array(c, path: str):
    return _batch(lambda v: dumps(path_of(path)(v)), "string")(c)


def json_path_query(c, path: str):
    """array of every match, for explode."""
    return _batch(lambda v: [dumps(x) for x in path_of(path)(v)], "array<string>")(c)


def json_object_keys(c):
    return _batch(lambda v: sorted(v, key=lambda k: (len(k.encode()), k.encode())), "array<string>")(c)


def json_array_elements(c):
    return _batch(lambda v: [dumps(x) for x in v], "array<string>")(c)


def json_array_elements_text(c):
    return _batch(lambda v: [text_of(x) for x in v], "array<string>")(c)


def json_each(c, text: bool = False):
    """array of (key, value), for inline."""
    show = text_of if text else dumps
    order = lambda v: sorted(v.items(), key=lambda e: (len(e[0].encode()), e[0].encode()))
    return _batch(lambda v: [{"key": k, "value": show(x)} for k, x in order(v)], "array<struct<key:string,value:string>>")(c)


def _entry(c: pa.Array) -> pa.Array:
    """Canonical text of the v of each {"v": ..}."""
    return _distinct(c, lambda e: dumps(e["v"]), "string")


def _joined(opening: str, comma: str, *rest) -> pa.Array:
    """Text and columns row by row, without the comma before the first item."""
    return pc.binary_join_element_wise(opening, *rest, "")


def _objects(names, entries) -> pa.Array:
    """Canonical objects of columns of names and of {"v": ..}; names are the same in all rows as a rule."""
    known = [c.unique().to_pylist() for c in names]
    if all(len(k) == 1 and isinstance(k[0], str) for k in known):
        last = {k[0]: c for k, c in zip(known, entries)}
        order = sorted(last, key=lambda k: (len(k.encode()), k.encode()))
        return _joined("{", *(x for k in order for x in (", ", _QUOTE(k) + ": ", _entry(last[k]))), "}")
    rows = zip(*(c.to_pylist() for c in (*names, *entries)))
    n = len(names)
    return pa.array([dumps({k: loads(v)["v"] for k, v in zip(row[:n], row[n:])}) for row in rows], pa.string())


def json_build_object(*pairs):
    """From alternating names and Columns, as canonical text."""
    names = [F.lit(p) if isinstance(p, str) else p for p in pairs[::2]]
    entries = [F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}) for v in pairs[1::2]]

    @F.arrow_udf("string")
    def run(*cols: pa.Array) -> pa.Array:
        return _objects(cols[: len(cols) // 2], cols[len(cols) // 2 :])

    return bound(run)(*names, *entries)


def json_build_array(*values):
    entries = [F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}) for v in values]

    @F.arrow_udf("string")
    def run(*cols: pa.Array) -> pa.Array:
        return _joined("[", *(x for c in cols for x in (", ", _entry(c))), "]")

    return bound(run)(*entries)


def json_object(keys, values):
    """From parallel arrays of text."""

    @F.pandas_udf("string")
    def run(k: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else dumps(dict(zip(a, b, strict=True))) for a, b in zip(k, v)], dtype=object)

    return bound(run)(keys, values)


def contained(a, b) -> bool:
    """Whether document a contains b: objects by members, arrays by elements, a scalar also in an array."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contained(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(contained(x, y) for x in a) for y in b)
        return not isinstance(b, dict) and any(not isinstance(x, (dict, list)) and kind(x) == kind(b) and x == b for x in a)
    return kind(a) == kind(b) and not isinstance(b, (dict, list)) and a == b


def json_contains(c, other: str):
    """c @> other."""
    b = loads(other)
    return _batch(lambda v: contained(v, b), "boolean")(c)


def json_contained_by(c, other: str):
    """c <@ other."""
    b = loads(other)
    return _batch(lambda v: contained(b, v), "boolean")(c)


def _has(v, key: str) -> bool:
    return key in v if isinstance(v, (dict, list)) else v == key


def json_exists_any(c, keys: list[str]):
    return _batch(lambda v: any(_has(v, k) for k in keys), "boolean")(c)


def json_exists_all(c, keys: list[str]):
    return _batch(lambda v: all(_has(v, k) for k in keys), "boolean")(c)


def is_json(c, what: str = "value"):
    """c IS JSON [VALUE | SCALAR | ARRAY | OBJECT]; NULL for NULL."""

    def test(s: str) -> bool:
        try:
            v = loads(s)
        except ValueError:
            return False
        return {"value": True, "scalar": not isinstance(v, (dict, list)), "array": isinstance(v, list), "object": isinstance(v, dict)}[what.lower()]

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else test(v) for v in s], dtype=object)

    return bound(run)(c)
