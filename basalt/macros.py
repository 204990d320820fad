"""The function library as SQL functions: a call in SQL text becomes the SQL of the Column that the library builds.

Arguments of Column parameters may be any expression; other parameters (patterns, formats, counts) are
constants.  Vectorised functions are registered in the session under a name made from function and constants.
"""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, fts, geometry, jsons, network, numeric, ranges, temporal, text, vectors
from .functions.udfs import REGISTER


class NotConstant(ValueError):
    """A parameter that must be a constant is given as an expression."""


def _range(step: str | None, kind: str) -> Callable[..., Column]:
    def make(lo: Column, hi: Column, bounds: str = "[)") -> Column:
        return ranges.make_range(lo.cast(kind), hi.cast(kind), bounds, step)

    return make


def _json_item(c, key: Column) -> Column:
    return jsons.json_extract_path(c, key)


#: SQL name: function of the library.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    # text
    "left": text.left, "right": text.right, "substr": text.substring, "substring": text.substring, "split_part": text.split_part, "initcap": text.initcap,
    "strpos": text.strpos, "quote_literal": text.quote_literal, "quote_nullable": text.quote_nullable, "quote_ident": text.quote_ident, "format": text.format_,
    "to_hex": text.to_hex, "encode": text.encode, "decode": text.decode, "sha224": text.sha224, "regexp_replace": text.regexp_replace, "regexp_match": text.regexp_match,
    "regexp_like": text.regexp_like, "regexp_count": text.regexp_count, "regexp_instr": text.regexp_instr, "regexp_substr": text.regexp_substr, "regexp_split_to_array": text.regexp_split_to_array,
    # numbers
    "gcd": numeric.gcd, "lcm": numeric.lcm, "factorial": numeric.factorial, "trunc": numeric.trunc, "log": numeric.log, "num_nulls": numeric.num_nulls, "num_nonnulls": numeric.num_nonnulls,
    "min_scale": numeric.min_scale, "width_bucket": numeric.width_bucket,
    # arrays
    "cardinality": arrays.cardinality, "array_length": arrays.array_length, "array_upper": arrays.array_length, "array_lower": arrays.array_lower, "array_ndims": arrays.array_ndims, "array_dims": arrays.array_dims,
    "array_fill": arrays.array_fill, "array_to_string": arrays.array_to_string, "string_to_array": arrays.string_to_array, "array_append": arrays.array_append, "array_prepend": arrays.array_prepend,
    "array_cat": arrays.array_cat, "array_position": arrays.array_position, "array_positions": arrays.array_positions, "array_remove": arrays.array_remove, "array_replace": arrays.array_replace, "trim_array": arrays.trim_array,
    # time
    "age": temporal.age, "date_part": temporal.date_part, "date_bin": temporal.date_bin, "to_char": temporal.to_char, "to_date": temporal.to_date, "to_timestamp": temporal.to_timestamp,
    "make_timestamp": temporal.make_timestamp, "justify_days": temporal.justify_days, "justify_hours": temporal.justify_hours, "justify_interval": temporal.justify_interval,
    # JSON
    "json_typeof": jsons.json_typeof, "json_array_length": jsons.json_array_length, "json_extract_path": jsons.json_extract_path, "json_extract_path_text": jsons.json_extract_path_text,
    "json_set": jsons.json_set, "json_insert": jsons.json_insert, "json_strip_nulls": jsons.json_strip_nulls, "json_pretty": jsons.json_pretty, "json_exists": jsons.json_exists, "json_path_exists": jsons.json_path_exists,
    "json_path_match": jsons.json_path_match, "json_path_query_first": jsons.json_path_query_first, "json_path_query_array": jsons.json_path_query_array, "json_build_object": jsons.json_build_object,
    "json_build_array": jsons.json_build_array, "json_object": jsons.json_object, "json_contains": jsons.json_contains, "json_contained_by": jsons.json_contained_by, "json_delete_path": jsons.json_delete_path,
    "json_canonical": jsons.canonical, "json_exists_any": jsons.json_exists_any, "json_exists_all": jsons.json_exists_all,
    # vectors and full text
    "inner_product": vectors.inner_product, "l2_distance": vectors.l2_distance, "l1_distance": vectors.l1_distance, "cosine_distance": vectors.cosine_distance, "vector_norm": vectors.vector_norm, "vector_dims": vectors.vector_dims,
    "to_tsvector": fts.to_tsvector, "to_tsquery": fts.to_tsquery, "plainto_tsquery": fts.plainto_tsquery, "ts_match": fts.ts_match, "ts_rank": fts.ts_rank, "numnode": fts.numnode, "strip": fts.strip, "setweight": fts.setweight,
    # ranges
    "int4range": _range("int", "int"), "int8range": _range("int", "bigint"), "numrange": _range(None, "decimal(38,10)"), "daterange": _range("date", "date"), "tsrange": _range(None, "timestamp_ntz"),
    "range_lower": ranges.lower, "range_upper": ranges.upper, "isempty": ranges.isempty, "lower_inf": ranges.lower_inf, "upper_inf": ranges.upper_inf, "range_merge": ranges.range_merge, "range_text": ranges.to_text,
    "range_contains": ranges.contains, "range_contains_value": ranges.contains_value, "range_overlaps": ranges.overlaps, "range_adjacent": ranges.adjacent, "range_intersection": ranges.intersection, "range_left": ranges.strictly_left,
    "lower_inc": lambda r: r["lower_inc"], "upper_inc": lambda r: r["upper_inc"], "array_contains_all": arrays.contains, "array_overlaps": arrays.overlaps, "array_slice": arrays.array_slice,
    # addresses and bits
    "host": network.host, "masklen": network.masklen, "family": network.family, "network": network.network, "broadcast": network.broadcast, "netmask": network.netmask, "hostmask": network.hostmask, "set_masklen": network.set_masklen,
    "abbrev": network.abbrev, "inet_merge": network.inet_merge, "inet_same_family": network.inet_same_family, "get_bit": network.get_bit, "set_bit": network.set_bit, "get_byte": network.get_byte, "set_byte": network.set_byte,
    "macaddr8_set7bit": network.macaddr8_set7bit,
    # geometry
    "point": geometry.point, "box": geometry.box, "circle": geometry.circle, "height": geometry.height, "width": geometry.width, "radius": geometry.radius, "diameter": geometry.diameter, "npoints": geometry.npoints,
    "isopen": geometry.isopen, "isclosed": geometry.isclosed, "lseg": geometry.lseg,
}
FUNCTIONS |= {name.replace("json_", "jsonb_", 1): f for name, f in FUNCTIONS.items() if name.startswith("json_")}

_OPERATORS = re.compile(r"""('(?:[^'\\]|\\.|'')*')|(?<![\w.])(\d+\.\d+(?:[eE][+-]?\d+)?)(?![\w.])|(?<![\w`])(and|or)\(|(<=>|<=|>=|==|!=|[-+*/%=<>!&|^])\(""")


def constant(arg: str):
    """The value of a literal, as a Python value."""
    t = arg.strip()
    if re.fullmatch(r"'(?:[^'\\]|\\.|'')*'", t):
        return re.sub(r"\\(.)", r"\1", t[1:-1].replace("''", "'"))
    if re.fullmatch(r"[-+]? ?\d+", t):
        return int(t.replace(" ", ""))
    if re.fullmatch(r"[-+]? ?\d+\.\d*", t):
        return float(t.replace(" ", ""))
    if t.lower() in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[t.lower()]
    if m := re.fullmatch(r"array\s*\((.*)\)", t, re.S | re.I):
        return [constant(x) for x in m[1].split(",")] if m[1].strip() else []
    raise NotConstant(f"{arg.strip()} must be a constant here")


def _wants_column(p: inspect.Parameter) -> bool:
    return "Column" in str(p.annotation) or p.annotation is inspect.Parameter.empty and p.default is inspect.Parameter.empty


def _render(c: Column, args: list[str]) -> str:
    """SQL of a Column over placeholders: its operators as function calls, then the arguments in their places."""
    put = lambda m: m[1] or (f"{m[2]}D" if m[2] else f"`{m[3] or m[4]}`(")
    out = _OPERATORS.sub(put, c._jc.node().sql())
    out = re.sub(r"\b(timestampadd|timestampdiff)\('(\w+)'", r"\1(\2", out)  # units are names there
    return re.sub(r"`?__arg(\d+)__`?", lambda m: f"({args[int(m[1])]})", out)


def expand(name: str, args: list[str]) -> str:
    """SQL text of a call of the library's function with these arguments as SQL text."""
    f = FUNCTIONS[name]
    given, consts = [], []
    params = list(inspect.signature(f).parameters.values())
    for k, a in enumerate(args):
        if k < len(params):
            p = params[k]
        elif params and params[-1].kind is inspect.Parameter.VAR_POSITIONAL:
            p = params[-1]
        else:
            raise ValueError(f"function {name} does not take {len(args)} arguments")
        if _wants_column(p) and not (name.endswith("_build_object") and k % 2 == 0 and re.fullmatch(r"\s*'[^'\\]*'\s*", a)):
            given.append(F.col(f"__arg{k}__"))
        else:
            given.append(constant(a))
            consts.append(given[-1])
    spark = SparkSession.active()

    def register(udf, n=[0]) -> str:  # noqa: B006
        n[0] += 1
        called = "basalt_" + hashlib.md5(repr((name, len(args), consts, n[0])).encode()).hexdigest()[:16]
        if not spark.catalog.functionExists(called):
            spark.udf.register(called, udf)
        return called

    token = REGISTER.set(register)
    try:
        return f"({_render(f(*given), args)})"
    finally:
        REGISTER.reset(token)
