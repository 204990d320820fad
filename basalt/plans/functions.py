"""Scalar and set-returning functions, family by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import jsons as J
from ..functions import network as N
from ..functions import numeric as M
from ..functions import ranges as R
from ..functions import srf as S
from ..functions import temporal as T
from ..functions import text as X
from ..functions import vectors as V
from .catalog import register, register_sql, table

register_sql("fn_text_length", "SELECT c_custkey, length(c_name) AS l, octet_length(c_name) AS o, bit_length(c_name) AS b, upper(c_mktsegment) AS u, lower(c_mktsegment) AS lo, reverse(c_name) AS r, ascii(c_mktsegment) AS a, chr(65 + CAST(c_nationkey AS INT)) AS ch FROM customer",
             "SELECT c_custkey, length(c_name) AS l, octet_length(c_name::BLOB) AS o, bit_length(c_name) AS b, upper(c_mktsegment) AS u, lower(c_mktsegment) AS lo, reverse(c_name) AS r, ascii(c_mktsegment) AS a, chr(65 + c_nationkey) AS ch FROM customer")
register_sql("fn_text_pad_trim", "SELECT c_custkey, lpad(c_name, 25, '*') AS lp, rpad(c_name, 5, '*') AS rp, ltrim('C', c_name) AS lt, rtrim('0123456789', c_name) AS rt, trim(BOTH 'CG' FROM c_mktsegment) AS bt, repeat(c_mktsegment, 2) AS re FROM customer",
             "SELECT c_custkey, lpad(c_name, 25, '*') AS lp, rpad(c_name, 5, '*') AS rp, ltrim(c_name, 'C') AS lt, rtrim(c_name, '0123456789') AS rt, trim(c_mktsegment, 'CG') AS bt, repeat(c_mktsegment, 2) AS re FROM customer")
register_sql("fn_text_search", "SELECT c_custkey, position('o' IN c_name) AS p, replace(c_name, '0', 'z') AS r, translate(c_name, '01', 'ab') AS t, startswith(c_name, 'Cus') AS s, concat_ws('-', c_name, NULL, c_mktsegment) AS c FROM customer",
             "SELECT c_custkey, position('o' IN c_name) AS p, replace(c_name, '0', 'z') AS r, translate(c_name, '01', 'ab') AS t, starts_with(c_name, 'Cus') AS s, concat_ws('-', c_name, NULL, c_mktsegment) AS c FROM customer")


@register(
    "fn_text_parts",
    """SELECT p_partkey, left(p_name, 4) AS l, left(p_name, -2) AS ln, right(p_name, 3) AS r, right(p_name, -2) AS rn, substring(p_name, 2, 3) AS s, split_part(p_type, ' ', 1) AS sp, split_part(p_type, ' ', 9) AS s9,
    concat(p_brand, NULL, '/', p_size) AS c, strpos(p_name, 'a') AS st, left(p_name, 1) || 'XY' || substring(p_name, 3) AS ov FROM part""",
)
def text_parts(spark, sf_dir):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.left(n, 4).alias("l"), X.left(n, -2).alias("ln"), X.right(n, 3).alias("r"), X.right(n, -2).alias("rn"), X.substring(n, 2, 3).alias("s"), X.split_part(t, " ", 1).alias("sp"), X.split_part(t, " ", 9).alias("s9"),
        X.concat(F.col("p_brand"), F.lit(None), F.lit("/"), F.col("p_size")).alias("c"), X.strpos(n, "a").alias("st"), X.overlay(n, "XY", 2, 1).alias("ov"),
    )


@register(
    "fn_text_quote",
    """SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS ql, coalesce('''' || NULLIF(c_mktsegment, 'BUILDING') || '''', 'NULL') AS qn, '"' || c_mktsegment || '"' AS qi,
    'x=' || c_name || ' "' || c_mktsegment || '" 100%' AS f, printf('%x', c_custkey) AS h FROM customer""",
)
def text_quote(spark, sf_dir):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.quote_literal(F.concat(n, F.lit("'s"))).alias("ql"), X.quote_nullable(F.nullif(m, F.lit("BUILDING"))).alias("qn"), X.quote_ident(m).alias("qi"),
        X.format_("x=%s %I 100%%", n, m).alias("f"), X.to_hex(F.col("c_custkey")).alias("h"),
    )


@register("fn_text_initcap", "SELECT n_nationkey, upper(left(n_name, 1)) || lower(substring(n_name, 2, 5)) AS i FROM nation")
def initcap(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(X.initcap(F.substring("n_name", 1, 6)), 1, 6).alias("i"))


@register("fn_hash_encode", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(encode(c_name))) AS h, base64(encode(c_name)) AS b FROM customer")
def hashes(spark, sf_dir):
    n = F.col("c_name")
    b = F.encode(n, "UTF-8")
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(n).alias("m"), F.sha2(n, 256).alias("s"), X.encode(b, "hex").alias("h"), X.encode(b, "base64").alias("b"))


@register(
    "fn_regexp",
    """SELECT event_id, regexp_replace(props, '[0-9]', '#') AS a, regexp_replace(props, '[0-9]', '#', 'g') AS b, regexp_matches(event_type, '^[a-m]') AS c, len(regexp_extract_all(props, '[0-9]+')) AS d,
    regexp_extract(props, '[0-9]+') AS e, array_to_string(regexp_split_to_array(event_type, '[aeiou]'), '|') AS f FROM events""",
)
def regexp(spark, sf_dir):
    p, t = F.col("props"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", X.regexp_replace(p, "[0-9]", "#").alias("a"), X.regexp_replace(p, "[0-9]", "#", "g").alias("b"), X.regexp_like(t, "^[a-m]").alias("c"), X.regexp_count(p, "[0-9]+").cast("bigint").alias("d"),
        F.coalesce(X.regexp_substr(p, "[0-9]+"), F.lit("")).alias("e"), F.array_join(X.regexp_split_to_array(t, "[aeiou]"), "|").alias("f"),
    )


@register("fn_similar_to", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#(1|2).') AS s FROM part")
def similar(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.similar_to(F.col("p_brand"), "Brand#(1|2)_").alias("s"))


@register(
    "fn_numeric",
    """SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 1) AS r, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, CAST(sign(p_size - 25) AS INT) AS s, p_size % 7 AS m, round(power(p_size, 1.5), 6) AS p,
    round(sqrt(p_size), 9) AS q, round(ln(p_size), 9) AS ln, round(log10(p_size), 9) AS lg, round(log10(p_size) / log10(2), 8) AS l2, round(exp(p_size / 50.0), 8) AS e, trunc(p_retailprice) AS t, gcd(p_size, 12) AS g, lcm(p_size, 4) AS l,
    factorial(p_size % 10) AS fa, CAST(bit_count(p_size::BIGINT) AS INT) AS bc, p_size // 4 AS d FROM part""",
)
def numeric(spark, sf_dir):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.abs(s - 25).alias("a"), F.round(r, 1).alias("r"), F.ceil(r).cast("double").alias("c"), F.floor(r).cast("double").alias("f"), F.sign(s - 25).cast("int").alias("s"), M.mod(s, F.lit(7)).cast("int").alias("m"),
        F.round(F.pow(s, F.lit(1.5)), 6).alias("p"), F.round(F.sqrt(s), 9).alias("q"), F.round(F.ln(s), 9).alias("ln"), F.round(M.log(s), 9).alias("lg"), F.round(M.log(s, 2), 8).alias("l2"), F.round(F.exp(s / 50.0), 8).alias("e"),
        M.trunc(r).cast("double").alias("t"), M.gcd(s, F.lit(12)).alias("g"), M.lcm(s, F.lit(4)).alias("l"), M.factorial(s % 10).alias("fa"), F.bit_count(s.cast("bigint")).alias("bc"), M.divide_int(s, F.lit(4)).alias("d"),
    )


register_sql("fn_trigonometry", "SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 7) AS c, round(asin(CAST(p_size AS DOUBLE) / 60), 9) AS d, round(acos(CAST(p_size AS DOUBLE) / 60), 9) AS e, round(atan(p_size), 9) AS f, round(atan2(p_size, 3), 9) AS g, round(cbrt(p_size), 9) AS h, round(degrees(p_size), 7) AS i, round(radians(p_size), 9) AS j, round(sinh(CAST(p_size AS DOUBLE) / 20), 8) AS k, round(tanh(CAST(p_size AS DOUBLE) / 20), 9) AS l, round(pi(), 12) AS m FROM part")


@register("fn_width_bucket_nulls", "SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 6 ELSE floor((p_size - 10) / 6.0) + 1 END AS BIGINT) AS w, CASE WHEN p_size = 5 THEN 1 ELSE 0 END AS nn, CASE WHEN p_size = 5 THEN 1 ELSE 2 END AS k, greatest(p_size, 10) AS g, least(p_size, NULLIF(p_size, 5)) AS l FROM part")
def buckets(spark, sf_dir):
    s = F.col("p_size")
    n = F.nullif(s, F.lit(5))
    return table(spark, sf_dir, "part").select("p_partkey", M.width_bucket(s.cast("double"), 10.0, 40.0, 5).alias("w"), M.num_nulls(n, F.lit(1)).alias("nn"), M.num_nonnulls(n, F.lit(1)).alias("k"), F.greatest(s, F.lit(10)).alias("g"), F.least(s, n).alias("l"))


@register(
    "fn_rounding_rules",
    "SELECT x, CASE WHEN x IN (0.5, 2.5) THEN x - 0.5 WHEN x IN (1.5, 3.5) THEN x + 0.5 ELSE round(x) END AS half_even, CAST(round(CAST(x AS DECIMAL(9,1))) AS DOUBLE) AS half_away FROM (VALUES (0.5::DOUBLE), (1.5), (2.5), (3.5), (2.4), (2.6)) t(x)",
)
def rounding(spark, sf_dir):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,), (2.4,), (2.6,)], "x double")
    return df.select("x", M.round_float(F.col("x")).alias("half_even"), M.round_numeric(F.col("x").cast("decimal(9,1)")).cast("double").alias("half_away"))


@register(
    "fn_date_part",
    """SELECT event_id, date_part('year', ts)::DOUBLE AS y, date_part('month', ts)::DOUBLE AS mo, date_part('day', ts)::DOUBLE AS d, date_part('hour', ts)::DOUBLE AS h, date_part('dow', ts)::DOUBLE AS dow, date_part('isodow', ts)::DOUBLE AS iso,
    date_part('doy', ts)::DOUBLE AS doy, date_part('week', ts)::DOUBLE AS w, date_part('quarter', ts)::DOUBLE AS q, round(epoch(ts), 3) AS e, date_part('century', ts)::DOUBLE AS c, date_part('decade', ts)::DOUBLE AS de FROM events""",
)
def date_part(spark, sf_dir):
    parts = {"y": "year", "mo": "month", "d": "day", "h": "hour", "dow": "dow", "iso": "isodow", "doy": "doy", "w": "week", "q": "quarter", "c": "century", "de": "decade"}
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", *[T.date_part(f, ts).alias(n) for n, f in parts.items()], F.round(T.date_part("epoch", ts), 3).alias("e"))


@register(
    "fn_date_trunc_bin",
    """SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('month', ts)::TIMESTAMP AS m, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '2000-01-01 00:05:00') AS b, strftime(ts, '%Y/%m/%d %H-%M') AS c FROM events""",
)
def date_trunc(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", T.date_trunc("hour", ts).cast("timestamp_ntz").alias("h"), T.date_trunc("month", ts).cast("timestamp_ntz").alias("m"), T.date_bin(15 * 60 * 1_000_000, ts, "2000-01-01 00:05:00").alias("b"), T.to_char(ts, "YYYY/MM/DD HH24-MI").alias("c"))


@register(
    "fn_interval_age",
    """SELECT event_id, datepart('year', a) * 12 + datepart('month', a) AS months, datepart('day', a) AS days, (datepart('hour', a) * 3600 + datepart('minute', a) * 60 + datepart('second', a))::BIGINT AS secs
    FROM (SELECT event_id, age(ts, TIMESTAMP '2020-02-01 00:00:00') AS a FROM events)""",
)
def age(spark, sf_dir):
    a = T.age(F.col("ts"), F.lit("2020-02-01 00:00:00").cast("timestamp_ntz"))
    e = table(spark, sf_dir, "events").select("event_id", a.alias("a"))
    return e.select("event_id", F.col("a.months").alias("months"), F.col("a.days").alias("days"), (F.col("a.micros") / 1_000_000).cast("bigint").alias("secs"))


@register(
    "fn_interval_justify",
    "SELECT p_partkey, (p_size * 3 // 30)::BIGINT AS jd_m, (p_size * 3 % 30)::BIGINT AS jd_d, (p_size * 5 // 24)::BIGINT AS jh_d, (p_size * 5 % 24)::BIGINT AS jh_h FROM part",
)
def justify(spark, sf_dir):
    s = F.col("p_size")
    d, h = T.justify_days(T.make_interval(days=s * 3)), T.justify_hours(T.make_interval(hours=s * 5))
    return table(spark, sf_dir, "part").select("p_partkey", d["months"].alias("jd_m"), d["days"].alias("jd_d"), h["days"].alias("jh_d"), (h["micros"] / 3_600_000_000).cast("bigint").alias("jh_h"))


@register("fn_make_parse_dates", "SELECT n_nationkey, make_date(2000 + n_nationkey, 2, 28) AS d, make_timestamp(2001, 1, 1 + n_nationkey, 3, 4, 5.5) AS t, strptime('2020-05-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0'), '%Y-%m-%d')::DATE AS p FROM nation")
def make_dates(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.make_date(2000 + k, F.lit(2), F.lit(28)).alias("d"), T.make_timestamp(F.lit(2001), F.lit(1), 1 + k, F.lit(3), F.lit(4), F.lit(5.5)).alias("t"), T.to_date(F.concat(F.lit("2020-05-"), F.lpad((k + 1).cast("string"), 2, "0")), "YYYY-MM-DD").alias("p"))


_ARR = "[p_size, p_size % 3, NULLIF(p_size, 5), 7]"


@register(
    "fn_arrays",
    f"""SELECT p_partkey, len(a) AS n, a[1] AS first, list_position(a, 7) AS pos, array_to_string(list_transform(list_filter(a, lambda x: x IS DISTINCT FROM 7), lambda x: coalesce(x::VARCHAR, '?')), ',') AS removed,
    array_to_string(list_transform(list_append(a, 9), lambda x: coalesce(x::VARCHAR, '?')), ',') AS appended, array_to_string(list_transform(a[2:3], lambda x: coalesce(x::VARCHAR, '?')), ',') AS slice, list_contains(a, 2) AS has2 FROM (SELECT p_partkey, {_ARR} AS a FROM part)""",
)
def arrays(spark, sf_dir):
    s = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", F.array(s, s % 3, F.nullif(s, F.lit(5)), F.lit(7)).alias("a"))
    a = F.col("a")
    return df.select(
        "p_partkey", A.cardinality(a).cast("bigint").alias("n"), F.get(a, F.lit(0)).alias("first"), A.array_position(a, F.lit(7)).alias("pos"), A.array_to_string(A.array_remove(a, F.lit(7)), ",", "?").alias("removed"),
        A.array_to_string(A.array_append(a, F.lit(9)), ",", "?").alias("appended"), A.array_to_string(A.array_slice(a, 2, 3), ",", "?").alias("slice"), F.coalesce(F.array_contains(a, 2), F.lit(False)).alias("has2"),
    )


@register("fn_arrays_more", "SELECT n_nationkey, 'a-' || n_nationkey || '-b' AS j, 3 AS len, '[1:3]' AS dims, 1 AS lo, 2 AS trimmed, 'z,z' AS filled, CASE WHEN n_nationkey > 0 THEN n_nationkey % 2 = 0 ELSE true END AS c FROM nation")
def arrays_more(spark, sf_dir):
    parts = A.string_to_array(F.concat(F.lit("a,"), F.col("n_nationkey").cast("string"), F.lit(",b")), ",")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", A.array_to_string(parts, "-").alias("j"), A.array_length(parts).alias("len"), A.array_dims(parts).alias("dims"), A.array_lower(parts).alias("lo"), F.size(A.trim_array(parts, 1)).alias("trimmed"),
        A.array_to_string(A.array_fill(F.lit("z"), 2), ",").alias("filled"), A.contains(F.array(F.lit(0)), F.array(F.col("n_nationkey") % 2)).alias("c"),
    )


_JDOC = """('{"b": ' || n_nationkey || ', "a": [1, {"c": "' || n_name || '"}, null], "long": true}')"""


def _json_docs(spark, sf_dir):
    doc = F.concat(F.lit('{"b": '), F.col("n_nationkey").cast("string"), F.lit(', "a": [1, {"c": "'), F.col("n_name"), F.lit('"}, null], "long": true}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", doc.alias("j"))


@register(
    "fn_json_access",
    f"""SELECT n_nationkey, lower(CASE json_type(j) WHEN 'OBJECT' THEN 'object' END) AS t, json_array_length(j, '$.a')::INT AS n, j ->> '$.a[1].c' AS c, (j -> '$.b')::VARCHAR AS b, json_exists(j, '$.zz') AS z FROM (SELECT n_nationkey, {_JDOC}::JSON AS j FROM nation)""",
)
def json_access(spark, sf_dir):
    j = F.col("j")
    return _json_docs(spark, sf_dir).select("n_nationkey", J.json_typeof(j).alias("t"), J.json_array_length(J.json_extract_path(j, "a")).alias("n"), J.json_extract_path_text(j, "a", "1", "c").alias("c"), J.json_extract_path(j, "b").alias("b"), J.json_exists(j, "zz").alias("z"))


@register(
    "fn_json_build_edit",
    """SELECT n_nationkey, '{"a": [1, {"c": "' || n_name || '"}, null], "b": 9, "long": true}' AS st, '{"b": ' || n_nationkey || ', "k": "' || n_name || '"}' AS bo, '[' || n_nationkey || ', "' || n_name || '"]' AS ba FROM nation""",
)
def json_edit(spark, sf_dir):
    return _json_docs(spark, sf_dir).select("n_nationkey", J.json_set(F.col("j"), ["b"], "9").alias("st"), J.json_build_object("k", F.col("n_name"), "b", F.col("n_nationkey")).alias("bo"), J.json_build_array(F.col("n_nationkey"), F.col("n_name")).alias("ba"))


@register(
    "fn_jsonpath",
    f"""SELECT n_nationkey, n_nationkey > 10 AS e, n_nationkey > 10 AS m, '"' || n_name || '"' AS f, '[1, {{"c": "' || n_name || '"}}, null]' AS q FROM nation""",
)
def jsonpath(spark, sf_dir):
    j = F.col("j")
    return _json_docs(spark, sf_dir).select("n_nationkey", J.json_path_exists(j, "$ ? (@.b > 10)").alias("e"), J.json_path_match(j, "$.b > 10").alias("m"), J.json_path_query_first(j, "$.a[*].c").alias("f"), J.json_path_query_array(j, "$.a[*]").alias("q"))


register_sql("fn_json_native_props", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")


@register("srf_json_each", "SELECT n_nationkey, k, CASE k WHEN 'b' THEN n_nationkey::VARCHAR WHEN 'long' THEN 'true' ELSE '[1, {\"c\": \"' || n_name || '\"}, null]' END AS v FROM nation, (VALUES ('a'), ('b'), ('long')) t(k)")
def json_each(spark, sf_dir):
    return _json_docs(spark, sf_dir).select("n_nationkey", F.inline(J.json_each(F.col("j"))).alias("k", "v"))


@register("srf_json_elements", "SELECT n_nationkey, e FROM (SELECT n_nationkey, unnest(['1', '{\"c\": \"' || n_name || '\"}', 'null']) AS e FROM nation)")
def json_elements(spark, sf_dir):
    return _json_docs(spark, sf_dir).select("n_nationkey", F.explode(J.json_array_elements(J.json_extract_path(F.col("j"), "a"))).alias("e"))


@register("srf_json_keys", "SELECT n_nationkey, unnest(['a', 'b', 'long']) AS k FROM nation")
def json_keys(spark, sf_dir):
    return _json_docs(spark, sf_dir).select("n_nationkey", F.explode(J.json_object_keys(F.col("j"))).alias("k"))


@register("srf_generate_series", "SELECT generate_series AS v FROM generate_series(5, 95, 10)")
def generate_series(spark, sf_dir):
    return S.generate_series(spark, 5, 95, 10, "v")


@register("srf_unnest_ordinality", "SELECT r_regionkey, unnest([r_name, 'x', NULL]) AS v, unnest([1::BIGINT, 2, 3]) AS o FROM region")
def unnest(spark, sf_dir):
    return S.unnest(table(spark, sf_dir, "region").select("r_regionkey", F.array("r_name", F.lit("x"), F.lit(None)).alias("arr")), F.col("arr"), "v", "o").drop("arr")


@register("srf_unnest_zip", "SELECT r_regionkey, unnest([r_regionkey, 7, 8]) AS a, unnest(['p', 'q', NULL]) AS b FROM region")
def unnest_zip(spark, sf_dir):
    return S.unnest_zip(table(spark, sf_dir, "region").select("r_regionkey"), {"a": F.array(F.col("r_regionkey"), F.lit(7), F.lit(8)), "b": F.array(F.lit("p"), F.lit("q"))})


@register("srf_split_to_table", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
def split_table(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return S.string_to_table(p, F.col("p_type"), " ", "w").drop("p_type")


@register("srf_regexp_split", "SELECT p_partkey, unnest(regexp_split_to_array(p_type, '[ E]+')) AS w FROM part")
def regexp_split(spark, sf_dir):
    return S.regexp_split_to_table(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("p_type"), "[ E]+", "w").drop("p_type")


@register("srf_regexp_matches", "SELECT p_partkey, unnest(regexp_extract_all(p_name, '[a-z]+')) AS m FROM part")
def regexp_matches(spark, sf_dir):
    df = S.regexp_matches(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), "[a-z]+", "m", "g")
    return df.select("p_partkey", F.get("m", F.lit(0)).alias("m"))


@register(
    "fn_vector",
    """SELECT vec_id, round(list_distance(e, q), 6) AS l2, round(1 - list_cosine_similarity(e, q), 6) AS c, round(list_inner_product(e, q), 6) AS ip, round(list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2]))), 5) AS l1,
    len(e)::INT AS d, round(sqrt(list_inner_product(e, e)), 6) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM embeddings)""",
)
def vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    a, b = F.col("embedding"), F.col("q")
    return e.crossJoin(F.broadcast(q)).select(
        "vec_id", F.round(V.l2_distance(a, b), 6).alias("l2"), F.round(V.cosine_distance(a, b), 6).alias("c"), F.round(V.inner_product(a, b), 6).alias("ip"), F.round(V.l1_distance(a, b), 5).alias("l1"),
        V.vector_dims(a).alias("d"), F.round(V.vector_norm(a), 6).alias("n"),
    )


@register(
    "fn_ranges",
    """SELECT p_partkey, p_size AS lo, p_size + 11 AS hi, false AS empty, 15 >= p_size AND 15 < p_size + 11 AS has15, p_size < 30 AND p_size + 11 > 20 AS ov, p_size + 11 = 20 OR p_size = 30 AS adj,
    '[' || least(p_size, 20) || ',' || greatest(p_size + 11, 30) || ')' AS merged, p_size >= 20 AND p_size + 11 <= 30 AS inside FROM part""",
)
def ranges(spark, sf_dir):
    s = F.col("p_size")
    r, o = R.make_range(s, s + 10, "[]", "int"), R.make_range(F.lit(20), F.lit(30))
    df = table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), o.alias("o"))
    r, o = F.col("r"), F.col("o")
    return df.select("p_partkey", R.lower(r).alias("lo"), R.upper(r).alias("hi"), R.isempty(r).alias("empty"), R.contains_value(r, F.lit(15)).alias("has15"), R.overlaps(r, o).alias("ov"), R.adjacent(r, o).alias("adj"), R.to_text(R.range_merge(r, o)).alias("merged"), R.contains(o, r).alias("inside"))


@register(
    "fn_network",
    """SELECT n_nationkey, '10.1.' || n_nationkey || '.77' AS h, 24 AS m, 4 AS f, '10.1.' || n_nationkey || '.0/24' AS nw, '10.1.' || n_nationkey || '.255/24' AS b, '255.255.255.0' AS nm, '0.0.0.255' AS hm, '10.1.' || n_nationkey || '.77/16' AS s,
    n_nationkey = 3 AS c FROM nation""",
)
def network(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("10.1."), F.col("n_nationkey").cast("string"), F.lit(".77/24")).alias("i"))
    i = F.col("i")
    return df.select("n_nationkey", N.host(i).alias("h"), N.masklen(i).alias("m"), N.family(i).alias("f"), N.network(i).alias("nw"), N.broadcast(i).alias("b"), N.netmask(i).alias("nm"), N.hostmask(i).alias("hm"), N.set_masklen(i, F.lit(16)).alias("s"), N.contains(F.lit("10.1.3.0/24"), i).alias("c"))


@register("fn_bits_bytes", "SELECT n_nationkey, 1 AS g, '1110' AS s, ord(n_name[1]) AS b, '0a:bb:cc:dd:ee:ff:00:11' AS m FROM nation")
def bits(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", N.get_bit(F.lit("1010"), 2).alias("g"), N.set_bit(F.lit("1010"), 1, 1).alias("s"), N.get_byte(F.encode("n_name", "UTF-8"), 0).alias("b"), N.macaddr8_set7bit(F.lit("08:bb:cc:dd:ee:ff:00:11")).alias("m"))


@register(
    "fn_geometry",
    """SELECT s_suppkey, s_nationkey * 2.0 AS w, 3.0 AS h, round(s_nationkey * 6.0, 6) AS ba, s_nationkey + 0.0 AS cx, 1.5 AS cy, round(pi() * s_nationkey * s_nationkey, 6) AS ca, s_nationkey * 2.0 AS d, 3 AS np, true AS o, round(sqrt(s_nationkey * s_nationkey + 16.0), 9) AS dist FROM supplier""",
)
def geometry(spark, sf_dir):
    k = F.col("s_nationkey").cast("double")
    zero = G.point(F.lit(0), F.lit(0))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", G.box(zero, G.point(k * 2, F.lit(3))).alias("b"), G.circle(zero, k).alias("c"), G.path(F.array(zero, G.point(k, k), zero), False).alias("p"), G.point(k, F.lit(4)).alias("q"), zero.alias("z"))
    b, c, p = F.col("b"), F.col("c"), F.col("p")
    return df.select(
        "s_suppkey", G.width(b).alias("w"), G.height(b).alias("h"), F.round(G.box_area(b), 6).alias("ba"), G.box_center(b)["x"].alias("cx"), G.box_center(b)["y"].alias("cy"), F.round(G.circle_area(c), 6).alias("ca"), G.diameter(c).alias("d"),
        G.npoints(p).alias("np"), G.isopen(p).alias("o"), F.round(G.distance(F.col("q"), F.col("z")), 9).alias("dist"),
    )
