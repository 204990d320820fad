"""Edge cases of operators and functions that the tables do not hold."""

import decimal

import pytest
from pyspark.sql import functions as F

from basalt.functions import arrays, fts, jsons, network, numeric, ranges, temporal, text
from basalt.operators import aggregates, dml, recursion, relational
from basalt.sources import copy


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_text(spark):
    s = F.lit("héllo wörld")
    assert one(spark, text.left(s, 0), text.left(s, -20), text.right(s, 20), text.substring(s, -1, 4), text.initcap(F.lit("o'neil-x 2nd")), text.split_part(F.lit("a,b"), ",", -1)) == ("", "", "héllo wörld", "hé", "O'Neil-X 2nd", "b")
    assert one(spark, text.concat(F.lit(None), F.lit("x")), text.regexp_replace(F.lit("aXbX"), "X", r"[\&]"), text.regexp_replace(F.lit("none"), "X", "y")) == ("x", "a[X]bX", "none")
    assert one(spark, text.regexp_match(F.lit("k=v"), "(.)=(.)"), text.regexp_match(F.lit("k"), "="), text.similar_to(F.lit("abc"), "a(b|c)*")) == (["k", "v"], None, True)
    assert one(spark, text.quote_ident(F.lit('we"ird')), text.quote_literal(F.lit("a'b\\c")), text.format_("%L %%", F.lit(None).cast("string"))) == ('"we""ird"', "E'a''b\\\\c'", "NULL %")


def test_numeric(spark):
    i = lambda n: F.lit(n).cast("bigint")
    assert one(spark, numeric.divide_int(i(-7), i(2)), numeric.trunc(F.lit(-1.57), 1), numeric.gcd(i(-12), i(18)), numeric.gcd(i(0), i(0)), numeric.lcm(i(4), i(6))) == (-3, -1.5, 6, 0, 12)
    assert one(spark, numeric.min_scale(F.lit(decimal.Decimal("1.2300"))), numeric.trim_scale(F.lit(decimal.Decimal("1.2300"))), numeric.to_int(F.lit(2.5)), numeric.to_int(F.lit(3.5))) == (2, "1.23", 2, 4)
    with pytest.raises(Exception, match="division by zero"):
        spark.range(1).select(numeric.divide_int(i(1), F.col("id"))).collect()


def test_arrays(spark):
    a = F.array(F.lit(1), F.lit(None).cast("int"), F.lit(1))
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.array_positions(a, F.lit(1)), arrays.array_position(a, F.lit(None)), arrays.array_remove(a, F.lit(None)), arrays.array_length(empty), arrays.array_dims(a)) == ([1, 3], 2, [1, 1], None, "[1:3]")
    assert one(spark, arrays.string_to_array(F.lit("a||b"), "||"), arrays.string_to_array(F.lit(""), ","), arrays.array_slice(a, 2, 9), arrays.contains(a, empty)) == (["a", "b"], [], [None, 1], True)


def test_temporal(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    got = one(spark, temporal.age(ts("2001-04-10 00:00:00"), ts("1957-06-13 12:00:00")), temporal.age(ts("2020-01-31 00:00:00"), ts("2020-02-01 00:00:00")))
    assert tuple(got[0])[0] == 43 * 12 + 9 and tuple(got[1])[:2] == (0, -1)
    j = one(spark, temporal.justify_interval(temporal.make_interval(months=1, days=-1, hours=25)))[0]
    assert tuple(j) == (1, 0, 3_600_000_000)
    assert str(one(spark, temporal.date_bin(900_000_000, ts("1969-12-31 23:59:00"), "1970-01-01 00:00:00"))[0]) == "1969-12-31 23:45:00"


def test_ranges(spark):
    n = lambda v: F.lit(v).cast("int")
    r = ranges.make_range(n(1), n(5), "[]", "int")
    none = ranges.make_range(n(3), n(3))
    assert one(spark, ranges.to_text(r), ranges.isempty(none), ranges.contains(r, none), ranges.to_text(ranges.make_range(n(None), n(3)))) == ("[1,6)", True, True, "(,3)")
    assert one(spark, ranges.to_text(ranges.range_merge(r, ranges.make_range(n(9), n(12)))), ranges.adjacent(r, ranges.make_range(n(6), n(7))), ranges.to_text(ranges.intersection(r, ranges.make_range(n(4), n(9))))) == ("[1,12)", True, "[4,6)")
    with pytest.raises(Exception, match="lower bound"):
        spark.range(1).select(ranges.make_range(n(5), n(1))).collect()


def test_network(spark):
    assert one(spark, network.abbrev(F.lit("10.1.0.0/16")), network.inet_merge(F.lit("192.168.1.5/24"), F.lit("192.168.2.5/24")), network.host(F.lit(None).cast("string")), network.family(F.lit("::1"))) == ("10.1/16", "192.168.0.0/22", None, 6)


def test_json(spark):
    j = F.lit('{"bb": 1, "a": [{"x": 1.50}, {"x": 2}], "n": null}')
    assert one(spark, jsons.canonical(j), jsons.json_strip_nulls(j), jsons.json_extract_path_text(j, "n")) == ('{"a": [{"x": 1.50}, {"x": 2}], "n": null, "bb": 1}', '{"a": [{"x": 1.50}, {"x": 2}], "bb": 1}', None)
    assert one(spark, jsons.json_path_query_array(j, "$.a[*] ? (@.x > 1.6 || exists(@.y)).x"), jsons.json_path_query_first(j, "$.zz"), jsons.json_path_match(j, "$.a.size() == 2")) == ("[2]", None, True)
    assert one(spark, jsons.json_insert(j, ["a", "0"], "7"), jsons.json_set(j, ["z"], "1", False), jsons.json_delete_path(j, ["a", "0"])) == ('{"a": [7, {"x": 1.50}, {"x": 2}], "n": null, "bb": 1}', '{"a": [{"x": 1.50}, {"x": 2}], "n": null, "bb": 1}', '{"a": [{"x": 2}], "n": null, "bb": 1}')
    assert one(spark, jsons.json_pretty(F.lit('{"a":[1]}')), jsons.json_exists(F.lit('["k"]'), "k")) == ('{\n    "a": [\n        1\n    ]\n}', True)


def test_full_text(spark):
    v = fts.to_tsvector(F.lit("The quick brown foxes are jumping"), "english")
    assert one(spark, v, fts.plainto_tsquery(F.lit("the Foxes jump"), "english"), fts.to_tsquery(F.lit("fox & (dogs | !cat)"), "simple")) == ("'brown':3 'fox':4 'jump':6 'quick':2", "'fox' & 'jump'", "'fox' & ( 'dogs' | !'cat' )")
    assert one(spark, fts.ts_match(v, F.lit("'fox' & !'cat'")), fts.strip(v), fts.setweight(F.lit("'a':1,2"), "B"), fts.numnode(F.lit("'a' & !'b'"))) == (True, "'brown' 'fox' 'jump' 'quick'", "'a':1B,2B", 4)
    assert fts.rank(fts.parse_vector("'a':1 'b':2"), fts.parse_query("'a' & 'b'", None)) == pytest.approx(0.0991032, rel=1e-4)


def test_aggregates_keep_nulls(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, None, "c"), (2, None, None)], "g int, o int, v string")
    got = {r.g: (r.a, r.s, r.j) for r in df.groupBy("g").agg(aggregates.array_agg(F.col("v"), F.col("o")).alias("a"), aggregates.string_agg(F.col("v"), "+", F.col("o")).alias("s"), aggregates.json_agg(F.col("v"), F.col("o"), descending=True).alias("j")).collect()}
    assert got == {1: ([None, "b", "c"], "b+c", '["c","b",null]'), 2: ([None], None, "[null]")}
    assert df.where("g > 5").agg(aggregates.array_agg(F.col("v")).alias("a")).first().a is None


def test_ties_and_quantifiers(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, None), (5, 1)], "id int, v int")
    assert sorted(r.id for r in relational.limit_with_ties(df, [relational.desc("v")], 1).collect()) == [3, 4]
    assert sorted(r.id for r in relational.limit_with_ties(df, [relational.asc("v")], 1, 1).collect()) == [1, 2]
    none = df.where("id > 9")
    assert relational.any_all(df.limit(1), F.col("v"), none, "v", ">", "ALL").first().matched is True
    assert relational.any_all(df.where("id = 1"), F.col("v"), df, "v", "<", "ANY").first().matched is None


def test_merge_and_upsert_errors(spark):
    t = spark.createDataFrame([(1, "a")], "id int, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
    with pytest.raises(Exception, match="twice"):
        dml.upsert(t, twice, ["id"], {"v": F.col("excluded.v")}).collect()
    with pytest.raises(Exception, match="twice"):
        dml.Merge(["id"]).when_matched_update({"v": F.col("s.v")}).apply(t, twice).collect()
    lone = spark.createDataFrame([(None, "n"), (None, "n")], "id int, v string")
    assert dml.upsert(t, lone, ["id"]).count() == 3


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "a int, b int")
    seed = edges.where("a = 1").select(F.col("a").alias("n"))
    out = recursion.recursive_union(seed, lambda w: w.join(edges, w.n == edges.a).select("b"))
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]


def test_copy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\\n\nc"), (2, None), (3, "")], "id int, s string")
    copy.write_text(df, str(tmp_path / "t"))
    assert sorted(copy.read_text(spark, str(tmp_path / "t"), df.schema).collect()) == sorted(df.collect())
    copy.write_csv(df.where("id <> 3"), str(tmp_path / "c"), header=True, null="NULL")
    assert copy.read_csv(spark, str(tmp_path / "c"), df.schema, header=True, null="NULL").count() == 2
