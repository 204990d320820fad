"""The text interface and table state."""

import pytest
from pyspark.sql import functions as F

from basalt import dialect
from basalt.operators.constraints import MaterializedView, Sequence, Table
from basalt.operators.routines import Script, SqlFunctions, register_scalar


@pytest.fixture(scope="module")
def t(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 5), (4, None, 1)], "id int, k string, v int")
    df.createOrReplaceTempView("dialect_t")
    return df


def run(spark, text):
    return [tuple(r) for r in dialect.sql(spark, text).collect()]


def test_null_order(spark, t):
    assert run(spark, "SELECT id FROM dialect_t ORDER BY v, id") == [(4,), (1,), (3,), (2,)]
    assert run(spark, "SELECT id FROM dialect_t ORDER BY v DESC, id LIMIT 2") == [(2,), (1,)]
    assert run(spark, "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY v DESC, id) AS r FROM dialect_t) x WHERE r = 1") == [(2,)]


def test_distinct_on_and_ties(spark, t):
    assert run(spark, "SELECT DISTINCT ON (k) k, id FROM dialect_t ORDER BY k, v DESC, id;") == [("a", 2), ("b", 3), (None, 4)]
    assert sorted(run(spark, "SELECT id FROM dialect_t WHERE v IS NOT NULL ORDER BY v DESC FETCH FIRST 1 ROWS WITH TIES")) == [(1,), (3,)]
    assert run(spark, "SELECT id FROM dialect_t ORDER BY id OFFSET 1 FETCH NEXT 2 ROWS ONLY") == [(2,), (3,)]


def test_spellings(spark, t):
    assert run(spark, "SELECT CONCAT(k, '-', id), '7'::INT4, CAST(id AS TEXT), (v > 3) IS UNKNOWN FROM dialect_t WHERE k IS NULL OR k SIMILAR TO '(b|c)%' ORDER BY id") == [("b-3", 7, "3", False), ("-4", 7, "4", False)]
    assert run(spark, 'SELECT "id" -- the key\nFROM dialect_t WHERE k = \'it\'\'s\'') == []


def test_refusals():
    for text in ("SELECT TOP 3 * FROM t", "SELECT a FROM t QUALIFY x = 1", "SELECT a FROM t WHERE a LIKE ANY ('x')", "SELECT a FROM t FETCH FIRST 2 ROWS WITH TIES", "SELECT lag(a) IGNORE NULLS OVER () FROM t", "SELECT (1"):
        with pytest.raises(dialect.UnsupportedSyntax):
            dialect.translate(text)


def test_sequences(spark):
    s = Sequence(10, 5)
    with pytest.raises(ValueError):
        s.currval()
    assert (s.nextval(), s.nextval(), s.currval(), s.setval(100), s.nextval(), s.setval(7, False), s.nextval()) == (10, 15, 15, 100, 105, 7, 7)
    got = sorted(r.n for r in Sequence(1).number(spark.range(0, 50, 1, 7), "n").collect())
    assert got == list(range(1, 51))


def test_constraints(spark, t):
    Table(primary_key=["id"], checks={"small": F.col("v") < 9}).check(t)
    for bad, message in ((Table(not_null=["v"]), "not-null"), (Table(unique=[["k"]]), "unique"), (Table(checks={"c": F.col("v") > 3}), "check"), (Table(foreign_keys=[(["v"], t, ["id"])]), "foreign key")):
        with pytest.raises(ValueError, match=message):
            bad.check(t)
    assert Table(generated={"g": F.col("id") * 2}).complete(t).agg(F.sum("g")).first()[0] == 20
    gone = t.where("id = 1").select(F.col("v").alias("p"))
    child = Table()
    assert child.delete_parents(t, gone, ["v"], ["p"], "CASCADE").count() == 2
    assert child.delete_parents(t, gone, ["v"], ["p"], "SET NULL").where("v IS NULL").count() == 3
    with pytest.raises(ValueError):
        child.delete_parents(t, gone, ["v"], ["p"])


def test_views_and_routines(spark, t, tmp_path):
    v = MaterializedView(lambda: t.groupBy("k").count(), str(tmp_path))
    assert v.read().count() == 3 and v.refresh().count() == 3
    f = SqlFunctions()
    f.create("loop", ["x"], "loop(x)")
    with pytest.raises(ValueError, match="deep"):
        f.inline("loop(1)")
    register_scalar(spark, "plus_one", lambda s: s + 1, "double")
    assert [r[0] for r in spark.sql("SELECT plus_one(CAST(v AS DOUBLE)) FROM dialect_t ORDER BY id").collect()] == [6.0, None, 6.0, 2.0]
    s = Script(spark)
    s.set("n", 0)
    s.while_(lambda s: s.variables["n"] < 4, lambda s: s.set("n", s.sql("SELECT :n + 1").first()[0]))
    assert s.variables["n"] == 4


def one(spark, text):
    return run(spark, "SELECT " + text)[0]


def test_meanings_that_hang_on_types(spark, t):
    from decimal import Decimal

    assert one(spark, "7/2, 7/2.0, (7)/(2)/2, '12.345'::numeric, round(2.5::float8), round(2.5)") == (3, Decimal("3.5"), 1, Decimal("12.345"), 2.0, 3)
    assert run(spark, "SELECT id/2 AS h FROM dialect_t WHERE id IN (SELECT max(id)/2*2 FROM dialect_t)") == [(2,)]
    assert one(spark, "sum(x.generate_series + 9223372036854775800) FROM generate_series(1, 3) AS x") == (Decimal(27670116110564327406),)
    assert one(spark, "7::float8 / 2::float8, CAST(7 AS DOUBLE) / CAST(2 AS DOUBLE)") == (3.5, 3.5)


def test_library_functions(spark):
    assert one(spark, "left('abc',-1), right('abc',-1), regexp_replace('aXbX','X','-'), log(100.0), trim('xax','x'), substr('hello',0,3), initcap('o-neil x_y')") == ("ab", "bc", "a-bX", 2.0, "a", "he", "O-Neil X_Y")
    assert one(spark, "string_agg(x.s, '-' ORDER BY x.n DESC), array_agg(x.n ORDER BY x.n), json_agg(x.n ORDER BY x.n DESC) FROM (VALUES ('a', 1), ('b', NULL), ('c', 3)) AS x(s, n)") == ("b-c-a", [1, 3, None], "[null, 3, 1]")
    with pytest.raises(ValueError):
        one(spark, "initcap('a', 'b', 'c')")
    with pytest.raises(ValueError):
        one(spark, "left('abc', x.id) FROM (SELECT 1 AS id) x")


def test_operators(spark):
    assert one(spark, """'{"a":{"b":[1,2]}}' -> 'a' -> 'b' ->> 1, '{"a":{"b":2}}' #>> '{a,b}', '{"a":1}'::jsonb ? 'a', '{"a":1}' @> '{"a":2}'""") == ("2", "2", True, False)
    assert one(spark, "'foobar' ~ '^foo', 'FOO' ~* 'foo', 'x' !~ 'y', 'a' || 'b' ~ 'ab$', 'a.b' ~ 'a\\.b', 1 + 2 ^ 3 * 2") == (True, True, True, True, True, 17.0)
    assert one(spark, "ARRAY[1,2,3] @> ARRAY[2], int4range(1,5) @> 5, ARRAY[1,2] && ARRAY[2,3], ARRAY[1] || ARRAY[2], (ARRAY[10,20,30])[2], (ARRAY[10,20,30])[9], (ARRAY[10,20,30])[2:3]") == (True, False, True, [1, 2], 20, None, [20, 30])
    assert one(spark, "5 # 3, 1 << 4, -8 >> 1, ~5, ARRAY[3.0, 4.0] <-> ARRAY[0.0, 0.0]") == (6, 16, -4, -6, 5.0)
    with pytest.raises(Exception, match="ARRAY"):
        one(spark, "x.v <=> 5 FROM (SELECT 1 AS v) x")
