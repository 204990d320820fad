"""Queries through the dialect's own SQL text, each held against SQL that spells the same meaning out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import dialect
from .catalog import TABLES, register, table


def register_text(name: str, text: str, oracle: str) -> None:
    """A query in the dialect's SQL over the tables it names."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return dialect.sql(spark, text)

    run.__name__ = name
    register(name, oracle)(run)


register_text(
    "sql_integer_division",
    "SELECT o_orderkey, o_custkey / 7 AS q, (100 - o_custkey) / 7 AS down, o_orderkey / 3 / 2 AS twice, (o_custkey / 2) * 1.5 AS mixed FROM orders",
    "SELECT o_orderkey, o_custkey // 7 AS q, (100 - o_custkey) // 7 AS down, o_orderkey // 3 // 2 AS twice, (o_custkey // 2) * 1.5 AS mixed FROM orders",
)
register_text(
    "sql_round_half_even",
    "SELECT o_orderkey, round((o_custkey * 0.5)::float8) AS f, round((o_custkey * 0.5)::numeric(20, 1))::int8 AS n FROM orders",
    "SELECT o_orderkey, round_even(o_custkey * 0.5, 0)::double AS f, round((o_custkey * 0.5)::decimal(20, 1))::bigint AS n FROM orders",
)
register_text("sql_sum_beyond_bigint", "SELECT o_orderstatus, sum(o_orderkey + 9000000000000000000)::text AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum((o_orderkey + 9000000000000000000)::hugeint)::varchar AS s FROM orders GROUP BY o_orderstatus")
register_text(
    "sql_text_functions",
    "SELECT c_custkey, left(c_name, -3) AS l, right(c_name, -9) AS r, substr(c_name, 0, 5) AS s, initcap('o-' || lower(c_mktsegment)) AS i, regexp_replace(c_name, '0', '-') AS one, "
    "regexp_replace(c_name, '0', '-', 'g') AS every, trim(c_mktsegment, 'AE') AS t, split_part(c_name, '#', -1) AS p, strpos(c_name, '#') AS at, quote_literal(c_mktsegment) AS ql FROM customer",
    "SELECT c_custkey, left(c_name, -3) AS l, right(c_name, -9) AS r, substring(c_name, 1, 4) AS s, 'O-' || upper(c_mktsegment[1]) || lower(substring(c_mktsegment, 2)) AS i, regexp_replace(c_name, '0', '-') AS one, "
    "replace(c_name, '0', '-') AS every, trim(c_mktsegment, 'AE') AS t, string_split(c_name, '#')[-1] AS p, instr(c_name, '#') AS at, '''' || c_mktsegment || '''' AS ql FROM customer",
)
register_text(
    "sql_pattern_operators",
    "SELECT p_partkey, p_name ~ '^[a-m]' AS m, p_type ~* 'econ|stand' AS i, p_name !~ 'widget$' AS n, p_brand || '-' || p_size ~ '1-\\d+$' AS j, p_type SIMILAR TO '(ECONOMY|SMALL)%' AS s FROM part",
    "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS m, regexp_matches(p_type, 'econ|stand', 'i') AS i, NOT regexp_matches(p_name, 'widget$') AS n, regexp_matches(p_brand || '-' || p_size, '1-\\d+$') AS j, "
    "starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'SMALL') AS s FROM part",
)
register_text(
    "sql_json_operators",
    """SELECT event_id, props ->> 'k' AS k, ('{"a": ' || props || ', "l": [1, 2, 3]}') -> 'a' ->> 'k' AS deep, ('{"a": ' || props || '}') #>> '{a,k}' AS path, """
    """jsonb_build_object('id', event_id, 'type', event_type) AS built, jsonb_build_object('id', event_id) ->> 'id' AS id, props @> '{"k": 7}' AS seven, jsonb_typeof(props -> 'k') AS kind FROM events""",
    """SELECT event_id, props ->> '$.k' AS k, props ->> '$.k' AS deep, props ->> '$.k' AS path, '{"id": ' || event_id || ', "type": "' || event_type || '"}' AS built, event_id::varchar AS id, """
    """coalesce((props ->> '$.k')::int = 7, false) AS seven, CASE WHEN props ->> '$.k' IS NOT NULL THEN 'number' END AS kind FROM events""",
)
register_text(
    "sql_array_operators",
    "SELECT o_orderkey, ARRAY[o_custkey, o_orderkey, 7] @> ARRAY[o_custkey, 7] AS has, ARRAY[o_custkey % 5, 1] && ARRAY[2, 3] AS meets, (ARRAY[o_orderkey, o_custkey, 9])[2] AS second, cardinality((ARRAY[1, o_custkey, 3])[2:3]) AS n, "
    "array_position(ARRAY[3, 4, o_custkey % 6], o_custkey % 6) AS at, array_to_string(ARRAY[o_custkey, o_orderkey] || ARRAY[5::int8], '/') AS text FROM orders",
    "SELECT o_orderkey, true AS has, o_custkey % 5 IN (2, 3) AS meets, o_custkey AS second, 2 AS n, CASE o_custkey % 6 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS at, concat(o_custkey, '/', o_orderkey, '/5') AS text FROM orders",
)
register_text(
    "sql_ordered_aggregates",
    "SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY c_custkey DESC) AS names, array_to_string(array_agg(c_custkey ORDER BY c_mktsegment, c_custkey), ',') AS keys FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY c_custkey DESC) AS names, string_agg(c_custkey::varchar, ',' ORDER BY c_mktsegment, c_custkey) AS keys FROM customer GROUP BY c_nationkey",
)
register_text(
    "sql_range_operators",
    "SELECT o_orderkey, int4range(o_custkey, o_custkey + 10) @> 100 AS has, int4range(o_custkey, o_custkey + 10, '[]') && int4range(50, 60) AS meets, lower(int4range(o_custkey, 9000000, '(]')) AS lo, "
    "upper(int4range(1, o_custkey + 2, '[]')) AS hi, int4range(o_custkey, 5000) << int4range(5000, 9000000) AS below, isempty(int4range(o_custkey, o_custkey)) AS none FROM orders WHERE o_custkey < 5000",
    "SELECT o_orderkey, o_custkey <= 100 AND 100 < o_custkey + 10 AS has, o_custkey < 60 AND o_custkey + 10 >= 50 AS meets, o_custkey + 1 AS lo, o_custkey + 3 AS hi, true AS below, true AS none FROM orders WHERE o_custkey < 5000",
)
register_text(
    "sql_integer_functions",
    "SELECT o_orderkey, gcd(o_custkey, 36) AS g, lcm(o_custkey % 50 + 1, 12) AS l, o_custkey # 21 AS x, (o_custkey & 15) << 2 AS up, o_orderkey >> 3 AS down, 2 ^ (o_custkey % 10) ^ 2 AS p, div(o_orderkey, 7) AS d, "
    "num_nulls(o_custkey, NULL, nullif(o_custkey % 2, 0)) AS nulls, to_hex(o_orderkey) AS h FROM orders",
    "SELECT o_orderkey, gcd(o_custkey, 36) AS g, lcm(o_custkey % 50 + 1, 12) AS l, xor(o_custkey, 21) AS x, (o_custkey & 15) * 4 AS up, o_orderkey // 8 AS down, pow(pow(2, o_custkey % 10), 2) AS p, o_orderkey // 7 AS d, "
    "CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END AS nulls, lower(to_hex(o_orderkey)) AS h FROM orders",
)
register_text(
    "sql_generate_series",
    "SELECT s.generate_series AS n, count(o_orderkey) AS orders_of FROM generate_series(1, 200) AS s LEFT JOIN orders ON o_custkey = s.generate_series GROUP BY s.generate_series",
    "SELECT s.n AS n, count(o_orderkey) AS orders_of FROM generate_series(1, 200) AS s(n) LEFT JOIN orders ON o_custkey = s.n GROUP BY s.n",
)
register_text(
    "sql_vector_operators",
    "SELECT o_orderkey, ARRAY[o_custkey, 3] <+> ARRAY[5, 4] AS l1, ARRAY[o_custkey, 3] <#> ARRAY[2, 10] AS ip, (ARRAY[o_custkey * 3, o_custkey * 4] <-> ARRAY[0, 0])::int8 AS l2 FROM orders",
    "SELECT o_orderkey, (abs(o_custkey - 5) + 1)::double AS l1, (-(o_custkey * 2 + 30))::double AS ip, o_custkey * 5 AS l2 FROM orders",
)
register_text(
    "sql_network_functions",
    "SELECT s_suppkey, host(concat('10.', s_nationkey, '.', s_suppkey % 250, '.9/20')) AS h, masklen(concat('10.0.0.0/', s_suppkey % 20 + 8)) AS m, network(concat('10.', s_nationkey, '.', s_suppkey % 250, '.9/24')) AS n, "
    "broadcast(concat('10.', s_nationkey, '.', s_suppkey % 250, '.9/24')) AS b, get_bit('0110', 2) AS bit FROM supplier",
    "SELECT s_suppkey, concat('10.', s_nationkey, '.', s_suppkey % 250, '.9') AS h, s_suppkey % 20 + 8 AS m, concat('10.', s_nationkey, '.', s_suppkey % 250, '.0/24') AS n, concat('10.', s_nationkey, '.', s_suppkey % 250, '.255/24') AS b, 1 AS bit FROM supplier",
)
register_text(
    "sql_full_text",
    "SELECT p_partkey, to_tsvector(p_name) @@ to_tsquery('widget & !cold') AS m, numnode(to_tsquery('a | b & c')) AS n FROM part",
    "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'widget') AND NOT list_contains(string_split(p_name, ' '), 'cold') AS m, 3 AS n FROM part",
)
register_text(
    "sql_time_functions",
    "SELECT o_orderkey, to_char(o_orderdate, 'YYYY/MM/DD HH24:MI') AS c, date_part('quarter', o_orderdate) AS q, date_part('dow', o_orderdate) AS dow, EXTRACT(DOY FROM o_orderdate) AS doy, date_bin(86400000000, o_orderdate, '1990-01-01') AS bin FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS c, quarter(o_orderdate)::double AS q, dayofweek(o_orderdate)::double AS dow, dayofyear(o_orderdate) AS doy, date_trunc('day', o_orderdate) AS bin FROM orders",
)
register_text(
    "sql_null_order_and_ties",
    "SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS seg FROM customer ORDER BY nullif(c_mktsegment, 'FURNITURE') DESC, c_nationkey FETCH FIRST 40 ROWS WITH TIES",
    "SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS seg, rank() OVER (ORDER BY nullif(c_mktsegment, 'FURNITURE') DESC NULLS FIRST, c_nationkey) AS r FROM customer) WHERE r <= 40",
)
