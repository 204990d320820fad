"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .catalog import register, register_sql, table

OW = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
register_sql("win_ranking", f"SELECT o_orderkey, row_number() OVER ({OW}) AS rn, ntile(3) OVER ({OW}) AS nt, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders")
register_sql("win_distribution", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part")
register_sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({OW}) AS a, lag(o_totalprice, 2, 0.0) OVER ({OW}) AS b, lead(o_orderkey, 1) OVER ({OW}) AS c FROM orders", f"SELECT o_orderkey, lag(o_totalprice) OVER ({OW}) AS a, lag(o_totalprice, 2, 0.0::DOUBLE) OVER ({OW}) AS b, lead(o_orderkey, 1) OVER ({OW}) AS c FROM orders")
register_sql("win_values", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({OW}) AS f, last_value(o_orderkey) OVER ({OW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({OW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders")
register_sql("win_aggregates", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({OW}), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER ({OW}) AS lo, max(o_totalprice) OVER ({OW}) AS hi FROM orders")
register_sql("win_rows_frame", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({OW} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a, count(*) OVER ({OW} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM orders")
register_sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
register_sql("win_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders")
register_sql("win_peers_default", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n FROM orders")
register_sql("win_over_aggregate", "SELECT o_custkey, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS r FROM orders GROUP BY o_custkey")
register_sql("win_named", "SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, round(sum(l_quantity) OVER w, 2) AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
register_sql("win_top_per_group", "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier) t WHERE r <= 2")


@register("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def groups(spark, sf_dir):
    g = W.with_group_number(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.col("p_size").asc_nulls_last()])
    return g.select("p_partkey", F.count("*").over(W.groups_frame(["p_brand"], -1, 1)).alias("n"))


_FRAME = "PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register(
    "win_exclude",
    f"SELECT p_partkey, CAST(sum(p_size) OVER ({_FRAME} EXCLUDE CURRENT ROW) AS BIGINT) AS a, CAST(sum(p_size) OVER ({_FRAME} EXCLUDE GROUP) AS BIGINT) AS b, count(p_size) OVER ({_FRAME} EXCLUDE TIES) AS c FROM part",
)
def exclude(spark, sf_dir):
    df, order = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), [F.col("p_size").asc_nulls_last()]
    for out, agg, what in (("a", "sum", "current row"), ("b", "sum", "group"), ("c", "count", "ties")):
        df = W.exclude(df, ["p_brand"], order, "p_size", out, agg, what)
    return df.select("p_partkey", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "c")


@register("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS m FROM orders")
def filtered(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    done = lambda s: F.col("o_orderstatus") == s
    return table(spark, sf_dir, "orders").select("o_orderkey", W.filtered(F.count, F.lit(1), done("F"), w).alias("n"), W.filtered(F.max, F.col("o_totalprice"), done("O"), w).alias("m"))
