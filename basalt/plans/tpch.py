"""Decision-support queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register, register_sql, table

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@register(
    "tpch_q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(revenue()), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@register(
    "tpch_q3_shipping_priority",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
def q3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1997-03-15 00:00:00'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").where("l_shipdate > TIMESTAMP_NTZ '1995-03-15 00:00:00'").select("l_orderkey", "l_extendedprice", "l_discount")
    j = li.join(o.join(c, o.o_custkey == c.c_custkey), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@register(
    "tpch_q5_local_supplier_volume",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
    GROUP BY n_name""",
)
def q5(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


register_sql(
    "tpch_q6_forecast_revenue",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1996-01-01 00:00:00' AND l_discount >= 0.02 AND l_quantity < 30",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount >= 0.02 AND l_quantity < 30",
)
register_sql(
    "tpch_q4_order_priority",
    "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) GROUP BY o_orderpriority",
)
register_sql(
    "tpch_q2_small_quantity_parts",
    "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < (SELECT avg(l_quantity) * 0.5 FROM lineitem) GROUP BY p_brand",
)
register_sql(
    "tpch_q10_returned_items",
    "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20",
)
register_sql(
    "tpch_q13_customer_distribution",
    "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count",
)
register_sql(
    "tpch_q18_large_orders",
    "SELECT o_orderkey, o_custkey, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY o_orderkey, o_custkey",
)
register_sql(
    "tpch_q22_no_orders",
    "SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
)
