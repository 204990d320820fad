"""Operators of expressions: JSON containment, periods, segments, arrays under ANY and ALL, pattern operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import jsons as J
from ..functions import ranges as R
from ..functions import text as X
from .catalog import register, register_sql, table

register_sql(
    "expr_bit_operators",
    "SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r, ~p_size AS n, +p_size AS p FROM part",
    "SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, p_size >> 1 AS r, ~p_size AS n, +p_size AS p FROM part",
)
register_sql("expr_comparisons", "SELECT p_partkey, p_size = 5 AS a, p_size <> 5 AS b, p_size < 5 AS c, p_size <= 5 AS d, p_size > 5 AS e, p_size >= 5 AS f, NOT (p_size = 5 OR p_size = 6) AND p_size % 2 = 0 AS g FROM part")
register_sql("expr_like_escape", r"SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_name NOT LIKE '%!%%' ESCAPE '!' AND p_brand ILIKE 'bRAND%'")
register_sql("expr_try_cast", "SELECT c_custkey, try_cast(substring(c_name, 1, 3) AS INT) AS a, try_cast(right(c_name, 3) AS INT) AS b FROM customer")
register_sql("expr_row_values", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 9))")
register_sql("expr_is_distinct", "SELECT p_partkey, NULLIF(p_size, 5) IS DISTINCT FROM NULLIF(p_size, 6) AS a, NULLIF(p_size, 5) IS NOT DISTINCT FROM NULL AS b FROM part")


@register("expr_json_operators", """SELECT n_nationkey, n_nationkey = 3 AS c, true AS cb, n_nationkey % 2 = 0 AS e, true AS any_, false AS all_, true AS j, false AS arr FROM nation""")
def json_operators(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    j = F.concat(F.lit('{"k": '), k, F.lit(', "t": ["x", '), k, F.lit("]"), F.when(F.col("n_nationkey") % 2 == 0, ', "even": 1').otherwise(""), F.lit("}"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", j.alias("j"))
    j = F.col("j")
    return df.select(
        "n_nationkey", J.json_contains(j, '{"t": [3]}').alias("c"), J.json_contained_by(F.lit('{"a": 1}'), '{"a": 1, "b": [2]}').alias("cb"), J.json_exists(j, "even").alias("e"), J.json_exists_any(j, ["zz", "k"]).alias("any_"),
        J.json_exists_all(j, ["zz", "k"]).alias("all_"), J.is_json(j, "object").alias("j"), J.is_json(j, "array").alias("arr"),
    )


@register(
    "expr_periods_overlap",
    "SELECT o_orderkey, o_orderdate < TIMESTAMP '1997-01-01' AND o_orderdate + INTERVAL 30 DAYS > TIMESTAMP '1996-01-01' AS o FROM orders",
)
def periods(spark, sf_dir):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.periods_overlap(d, d + F.expr("INTERVAL 30 DAYS"), ts("1996-01-01 00:00:00"), ts("1997-01-01 00:00:00")).alias("o"))


@register("expr_array_quantifiers", "SELECT p_partkey, p_size IN (3, 5, 8) AS a, p_size > 8 AS b, CASE WHEN p_size = 3 THEN true END AS c, p_size IN (1, 2) AS d FROM part")
def array_quantifiers(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", A.any_of("=", s, F.array(F.lit(3), F.lit(5), F.lit(8))).alias("a"), A.all_of(">", s, F.array(F.lit(3), F.lit(8))).alias("b"),
        A.any_of("=", s, F.array(F.lit(3), F.lit(None).cast("int"))).alias("c"), A.overlaps(F.array(s), F.array(F.lit(1), F.lit(2))).alias("d"),
    )


@register("expr_regex_operators", "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS a, regexp_matches(p_name, '^[A-M]', 'i') AS b, NOT regexp_matches(p_name, 'e') AS c FROM part")
def regex_operators(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.regex_match(n, "^[a-m]").alias("a"), X.regex_match(n, "^[A-M]", True).alias("b"), X.regex_match(n, "e", negated=True).alias("c"))


@register("expr_encrypt_round_trip", "SELECT c_custkey, c_name AS back FROM customer")
def encrypt(spark, sf_dir):
    key = F.lit("secret")
    return table(spark, sf_dir, "customer").select("c_custkey", X.decrypt(X.encrypt(F.col("c_name"), key), key).alias("back"))


@register("expr_segments", "SELECT s_suppkey, s_nationkey <= 10 AS x, s_nationkey = 0 AS par, s_nationkey = 0 AS same, s_suppkey >= 0 AS perp FROM supplier")
def segments(spark, sf_dir):
    k = F.col("s_nationkey").cast("double")
    p = lambda x, y: G.point(F.lit(x) if not hasattr(x, "cast") else x, F.lit(y) if not hasattr(y, "cast") else y)
    base = G.lseg(p(0, 0), p(10, 0))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", base.alias("s"), G.lseg(p(k, -1), p(k, 1)).alias("t"), G.lseg(p(0, 5), p(10, k + 5)).alias("u"), p(k, 0).alias("q"), p(0, 0).alias("z"))
    s, t = F.col("s"), F.col("t")
    return df.select("s_suppkey", G.intersects(s, t).alias("x"), G.parallel(s, F.col("u")).alias("par"), G.same_as(F.col("q"), F.col("z")).alias("same"), G.perpendicular(s, t).alias("perp"))


@register("expr_range_operators", "SELECT p_partkey, p_size + 5 <= 30 AS nr, p_size >= 20 AS nl, p_size + 5 <= 20 AS sl FROM part")
def range_operators(spark, sf_dir):
    s = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", R.make_range(s, s + 5).alias("r"), R.make_range(F.lit(20), F.lit(30)).alias("o"))
    r, o = F.col("r"), F.col("o")
    return df.select("p_partkey", R.not_right_of(r, o).alias("nr"), R.not_left_of(r, o).alias("nl"), R.strictly_left(r, o).alias("sl"))
