"""Scans, filters, joins, subqueries, set operations, ordering and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.recursion import recursive_union
from .catalog import register, register_sql, table

register_sql("scan_project", "SELECT c_custkey, c_name, c_nationkey + 1 AS next_nation FROM customer")
register_sql("scan_count_star", "SELECT count(*) AS n FROM lineitem")
register_sql("scan_point_filter", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
register_sql("select_without_from", "SELECT 1 AS a, 'x' AS b, CAST(NULL AS INT) AS c")
register_sql("values_relation", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS v(a, b)")
register_sql("filter_three_valued", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND NULLIF(p_size, 5) <> 7)")
register_sql("filter_is_predicates", "SELECT p_partkey, (p_size > 20) IS TRUE AS t, (NULLIF(p_size, 3) > 20) IS NULL AS u, NULLIF(p_size, 3) IS DISTINCT FROM 4 AS d FROM part")
register_sql("filter_like_in", "SELECT p_partkey, p_type FROM part WHERE p_name LIKE '%a%' AND p_size IN (1, 2, 3, 5, 8, 13) AND p_brand NOT LIKE '_rand#1%'")
register_sql("filter_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
register_sql("group_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10 AND avg(l_quantity) > 20")
register_sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
register_sql("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
register_sql("sort_nulls", "SELECT p_partkey, k FROM (SELECT p_partkey, NULLIF(p_size, 7) AS k FROM part) t ORDER BY k ASC NULLS LAST, p_partkey LIMIT 50")
register_sql("sort_nulls_desc", "SELECT p_partkey, k FROM (SELECT p_partkey, NULLIF(p_size, 7) AS k FROM part) t ORDER BY k DESC NULLS FIRST, p_partkey LIMIT 50")
register_sql("sort_by_subquery_key", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer ORDER BY n DESC, c_custkey LIMIT 15")


@register(
    "limit_with_ties",
    "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5",
)
def limit_with_ties(spark, sf_dir):
    return R.limit_with_ties(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [R.desc("p_size")], 5)


@register(
    "distinct_on",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def distinct_on(spark, sf_dir):
    return R.distinct_on(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [R.desc("o_totalprice"), R.asc("o_orderkey")])


register_sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
register_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000")
register_sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000")
register_sql("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) s FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON s_suppkey = c_custkey")
register_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
register_sql("join_using_full", "SELECT k, a.v AS x, b.v AS y FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey > 8) b USING (k)")
register_sql("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey FROM nation WHERE n_nationkey > 5) b")
register_sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
register_sql("join_non_equi_left", "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_nationkey < r_regionkey * 3 GROUP BY r_regionkey")
register_sql("join_null_keys", "SELECT count(*) AS n FROM (SELECT NULLIF(p_size, 5) AS k FROM part) a JOIN (SELECT NULLIF(p_size, 5) AS k FROM part WHERE p_partkey < 50) b ON a.k = b.k")
register_sql("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
register_sql("join_comma_from", "SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey")
register_sql("join_five_tables", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
register_sql("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
register_sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
register_sql("subquery_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
register_sql("subquery_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
register_sql("subquery_not_in_null", "SELECT count(*) AS n FROM part WHERE p_size NOT IN (SELECT NULLIF(p_size, 5) FROM part)")
register_sql("subquery_row_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM lineitem GROUP BY l_orderkey)")
register_sql("subquery_scalar", "SELECT p_partkey, (SELECT max(l_quantity) FROM lineitem) AS m FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
register_sql("subquery_correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
register_sql("subquery_derived", "SELECT k, n FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS t(k, n) WHERE n > 5")


@register(
    "subquery_any_all",
    """SELECT p_partkey, p_size > ALL (SELECT s_nationkey FROM supplier) AS above_all, p_size > ANY (SELECT s_nationkey FROM supplier) AS above_any FROM part""",
)
def any_all(spark, sf_dir):
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_size"), table(spark, sf_dir, "supplier")
    a = R.any_all(p, F.col("p_size"), s, "s_nationkey", ">", "ALL").withColumnRenamed("matched", "above_all")
    return R.any_all(a, F.col("p_size"), s, "s_nationkey", ">", "ANY").withColumnRenamed("matched", "above_any").drop("p_size")


@register(
    "join_lateral_top_k",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
)
def lateral_top_k(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return R.top_k_per_row(c, o, ["c_custkey"], [R.desc("o_totalprice"), R.asc("o_orderkey")], 2)


register_sql("join_lateral_aggregate", "SELECT n_name, t.n FROM nation, LATERAL (SELECT count(*) AS n FROM supplier WHERE s_nationkey = n_nationkey) t")
register_sql("cte_chain", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE t > (SELECT avg(t) FROM a)) SELECT count(*) AS n FROM b")
register_sql("cte_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@register(
    "cte_recursive_distinct",
    """WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT (n_regionkey * 7 + n_nationkey) % 25 FROM r JOIN nation ON n_nationkey = (r.n + 4) % 25) SELECT n FROM r""",
)
def recursive_distinct(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    step = lambda w: w.join(n, F.col("n_nationkey") == (F.col("n") + 4) % 25).select(((F.col("n_regionkey") * 7 + F.col("n_nationkey")) % 25).alias("n"))
    return recursive_union(spark.range(1).select(F.lit(0).alias("n")), step)


A, B = "SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_orderkey < 400", "SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_orderkey > 300 AND l_orderkey < 600"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    register_sql(f"setop_{_name}", f"{A} {_op} {B}")
register_sql("setop_tree", "(SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region) EXCEPT SELECT 4 AS k ORDER BY k LIMIT 5")
register_sql("setop_nulls", "SELECT NULLIF(p_size, 5) AS k FROM part INTERSECT SELECT NULLIF(p_size, 5) FROM part WHERE p_partkey % 2 = 0")
register_sql("expr_between_null", "SELECT p_partkey, CASE WHEN NULLIF(p_size, 5) IS NULL THEN NULL ELSE p_size BETWEEN 3 AND 9 END AS b FROM part")
register_sql("expr_concat_operators", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS b FROM customer")
register_sql("expr_arithmetic", "SELECT p_partkey, p_size % 7 AS m, -p_size AS neg, (p_size + 3) * 2 - 1 AS x, CAST(p_size AS DOUBLE) / 4 AS q, CAST(floor(p_size / 7.0) AS INT) AS d, p_size & 12 AS ba, p_size | 3 AS bo FROM part")
register_sql("expr_casts", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_partkey AS DOUBLE) AS d, CAST('12.50' AS DECIMAL(6,2)) AS n, CAST('1999-02-03' AS DATE) AS dt FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_partkey AS DOUBLE) AS d, CAST('12.50' AS DECIMAL(6,2)) AS n, CAST('1999-02-03' AS DATE) AS dt FROM part")
