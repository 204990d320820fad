"""Session state: variables, prepared statements, types, policies, procedures."""

import pytest
from pyspark.sql import functions as F

from basalt.state import Domain, Session, enum_rank, enum_type


@pytest.fixture(scope="module")
def s(spark):
    spark.createDataFrame([(1, "low", "ann"), (2, "high", "bob"), (3, None, "ann")], "id int, level string, owner string").createOrReplaceTempView("state_t")
    return Session(spark)


def test_variables_and_prepared(s):
    s.set("Search_Path", "x")
    assert s.show("search_path") == "x"
    s.reset("search_path")
    assert s.show("search_path") is None
    s.prepare("q", "SELECT id FROM state_t WHERE id > $1 AND owner = $2 ORDER BY level, id")
    assert [r.id for r in s.execute("q", 0, "ann").collect()] == [1, 3]
    with pytest.raises(ValueError):
        s.prepare("q", "SELECT 1")
    s.deallocate("q")
    with pytest.raises(KeyError):
        s.execute("q")
    assert "Physical Plan" in s.explain("SELECT id FROM state_t WHERE id = 1")


def test_types(s):
    level = enum_type("low", "mid", "high")
    t = s.spark.table("state_t")
    assert [r[0] for r in t.orderBy(enum_rank(F.col("level"), "low", "mid", "high").desc_nulls_first(), "id").select(level.values(F.col("level"))).collect()] == [None, "high", "low"]
    with pytest.raises(Exception, match="domain check"):
        t.select(enum_type("low").values(F.col("level"))).collect()
    with pytest.raises(Exception, match="null values"):
        t.select(Domain("string", not_null=True).values(F.col("level"))).collect()


def test_policies(s):
    assert s.visible("state_t").count() == 3
    s.add_policy("state_t", "id < 3", restrictive=True)
    assert s.visible("state_t").count() == 0
    s.add_policy("state_t", "owner = 'ann'")
    assert [r.id for r in s.visible("state_t").collect()] == [1]
    s.add_policy("state_t", "owner = 'bob'")
    assert s.visible("state_t").count() == 2


def test_procedures(s):
    s.create_procedure("down", lambda session, n: n if n == 0 else session.call("down", n - 1))
    assert s.call("DOWN", 10) == 0
    with pytest.raises(RecursionError):
        s.call("down", 100)
