"""Aggregates, modifiers and grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .catalog import register, register_sql, table

register_sql("agg_basic", "SELECT count(*) AS n, count(NULLIF(p_size, 5)) AS c, CAST(sum(p_size) AS BIGINT) AS s, min(p_size) AS lo, max(p_name) AS hi, round(avg(p_retailprice), 4) AS a FROM part")
register_sql("agg_empty_input", "SELECT count(*) AS n, sum(p_size) AS s, max(p_name) AS m, avg(p_size) AS a FROM part WHERE p_partkey < 0")
register_sql("agg_group_null_key", "SELECT k, count(*) AS n FROM (SELECT NULLIF(p_size % 4, 1) AS k FROM part) t GROUP BY k")
register_sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
register_sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 2) AS even FROM orders GROUP BY o_orderstatus")
register_sql("agg_bool", "SELECT c_mktsegment, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS o FROM customer GROUP BY c_mktsegment")
register_sql("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag")
register_sql("agg_corr_covar", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_tax, l_discount), 8) AS cp, round(covar_samp(l_tax, l_discount), 8) AS cs FROM lineitem GROUP BY l_returnflag")
register_sql(
    "agg_regression",
    "SELECT l_linestatus, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay, round(regr_slope(l_extendedprice, l_quantity), 3) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 1) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_sxx(l_extendedprice, l_quantity) / 1000, 2) AS sxx FROM lineitem GROUP BY l_linestatus",
)
register_sql("agg_bits", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM part GROUP BY p_brand")
register_sql("agg_percentile", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity DESC) AS p9 FROM lineitem GROUP BY l_returnflag")
register_sql("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping(c_mktsegment) AS g1, grouping(c_nationkey) AS g2 FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
register_sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
register_sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
register_sql("agg_group_expression", "SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY 1")


@register("agg_sum_bigint_exact", "SELECT CAST(sum(CAST(o_orderkey AS HUGEINT) * 1000000000000) AS DECIMAL(38,0)) AS s FROM orders")
def sum_exact(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(A.sum_exact(F.col("o_orderkey").cast("decimal(38,0)") * 1_000_000_000_000).alias("s"))


@register("agg_mode", "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_linenumber) AS m FROM (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linenumber <= 2 OR l_orderkey % 2 = 0) GROUP BY l_returnflag")
def mode(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 OR l_orderkey % 2 = 0").groupBy("l_returnflag").agg(A.mode(F.col("l_linenumber")).alias("m"))


@register(
    "agg_hypothetical",
    """SELECT p_brand, 1 + count(*) FILTER (WHERE p_size < 20) AS rank, 1 + count(DISTINCT p_size) FILTER (WHERE p_size < 20) AS dense_rank,
    round(count(*) FILTER (WHERE p_size < 20) / count(*)::DOUBLE, 6) AS percent_rank, round((count(*) FILTER (WHERE p_size <= 20) + 1) / (count(*) + 1)::DOUBLE, 6) AS cume_dist FROM part GROUP BY p_brand""",
)
def hypothetical(spark, sf_dir):
    c = [F.col("p_size")]
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        A.hypothetical_rank([20], c).alias("rank"), A.hypothetical_dense_rank([20], c).alias("dense_rank"),
        F.round(A.hypothetical_percent_rank([20], c), 6).alias("percent_rank"), F.round(A.hypothetical_cume_dist([20], c), 6).alias("cume_dist"),
    )


@register(
    "agg_array_agg",
    "SELECT n_regionkey, array_to_string(array_agg(coalesce(NULLIF(n_name, 'NATION_7'), 'null') ORDER BY n_nationkey DESC), ',') AS names, len(array_agg(NULLIF(n_nationkey, 7))) AS n FROM nation GROUP BY n_regionkey",
)
def array_agg(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = A.array_agg(F.nullif(F.col("n_name"), F.lit("NATION_7")), F.col("n_nationkey"), descending=True)
    return n.groupBy("n_regionkey").agg(F.array_join(names, ",", "null").alias("names"), F.size(A.array_agg(F.nullif(F.col("n_nationkey"), F.lit(7)))).cast("bigint").alias("n"))


@register("agg_string_agg", "SELECT n_regionkey, string_agg(NULLIF(n_name, 'NATION_3'), '; ' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey")
def string_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.string_agg(F.nullif(F.col("n_name"), F.lit("NATION_3")), "; ", F.col("n_name")).alias("s"))


@register("agg_json_agg", "SELECT n_regionkey, '[' || string_agg(coalesce('\"' || NULLIF(n_name, 'NATION_3') || '\"', 'null'), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def json_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.json_agg(F.nullif(F.col("n_name"), F.lit("NATION_3")), F.col("n_nationkey")).alias("j"))


@register("agg_json_object_agg", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def json_object_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("j"))


@register("agg_count_distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)")
def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(A.count_rows(F.col("l_suppkey"), F.col("l_linenumber")).alias("n"))
