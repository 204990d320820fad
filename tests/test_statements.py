"""Writes, transactions and session statements as SQL text."""

import pytest

from basalt.statements import Database


@pytest.fixture(scope="module")
def db(spark):
    d = Database(spark)
    d.run("CREATE TABLE st_kind (k INT PRIMARY KEY, label TEXT)")
    d.run("CREATE TABLE st_item (id INT PRIMARY KEY, k INT REFERENCES st_kind (k), n INT NOT NULL DEFAULT 7 CHECK (n > 0), twice INT GENERATED ALWAYS AS (n * 2) STORED, note TEXT)")
    d.run("INSERT INTO st_kind VALUES (1, 'one'), (2, 'two')")
    return d


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_writes(db):
    got = db.run("INSERT INTO st_item (id, k, n, note) VALUES (1, 1, 5, 'it''s'), (2, 2, 6, NULL) RETURNING id, twice AS t, n / 2 AS h")
    assert rows(got) == [(1, 10, 2), (2, 12, 3)]
    db.run("INSERT INTO st_item (id) VALUES (3)")
    assert rows(db.run("SELECT id, k, n, twice FROM st_item")) == [(1, 1, 5, 10), (2, 2, 6, 12), (3, None, 7, 14)]
    for bad, message in (
        ("INSERT INTO st_item (id) VALUES (3)", "unique"), ("INSERT INTO st_item (id, n) VALUES (9, -1)", "check"), ("INSERT INTO st_item (id, n) VALUES (9, NULL)", "not-null"),
        ("INSERT INTO st_item (id, k) VALUES (9, 99)", "foreign"), ("UPDATE st_item SET id = 1", "unique"), ("DELETE FROM st_kind WHERE k = 1", "foreign"),
        ("INSERT INTO st_item (id, twice) VALUES (9, 1)", "generated"), ("INSERT INTO st_item (nope) VALUES (9)", "exist"),
    ):
        with pytest.raises(ValueError, match=message):
            db.run(bad)
    assert db.run("SELECT * FROM st_item").count() == 3
    assert rows(db.run("UPDATE st_item AS i SET n = i.n + 1, note = 'x' WHERE i.id >= 2 RETURNING id, n, twice")) == [(2, 7, 14), (3, 8, 16)]
    assert rows(db.run("UPDATE st_item SET note = s.label FROM st_kind AS s WHERE s.k = st_item.k RETURNING id, note")) == [(1, "one"), (2, "two")]
    assert rows(db.run("DELETE FROM st_item USING st_kind AS s WHERE s.k = st_item.k AND s.label = 'two' RETURNING id")) == [(2,)]
    assert rows(db.run("SELECT id, n, note FROM st_item")) == [(1, 5, "one"), (3, 8, "x")]


def test_upsert(db):
    db.run("CREATE TABLE st_count (k TEXT PRIMARY KEY, n INT)")
    db.run("INSERT INTO st_count VALUES ('a', 1), ('b', 2)")
    assert rows(db.run("INSERT INTO st_count VALUES ('a', 10), ('c', 3) ON CONFLICT (k) DO UPDATE SET n = st_count.n + excluded.n RETURNING k, n")) == [("a", 11), ("c", 3)]
    assert rows(db.run("INSERT INTO st_count VALUES ('a', 0), ('d', 4), ('d', 5) ON CONFLICT DO NOTHING RETURNING k, n")) == [("d", 4)]
    db.run("INSERT INTO st_count VALUES ('b', 100) ON CONFLICT (k) DO UPDATE SET n = excluded.n WHERE st_count.n > 50")
    assert rows(db.run("SELECT * FROM st_count")) == [("a", 11), ("b", 2), ("c", 3), ("d", 4)]
    with pytest.raises(ValueError, match="second time"):
        db.run("INSERT INTO st_count VALUES ('e', 0), ('e', 4) ON CONFLICT (k) DO UPDATE SET n = 1")


def test_transactions_and_session(db):
    db.run("CREATE TABLE st_log AS SELECT 1 AS x")
    db.run("BEGIN")
    db.run("DELETE FROM st_log")
    db.run("SAVEPOINT s")
    db.run("INSERT INTO st_log VALUES (5)")
    db.run("ROLLBACK TO s")
    assert rows(db.run("SELECT * FROM st_log")) == []
    db.run("ROLLBACK")
    assert rows(db.run("SELECT * FROM st_log")) == [(1,)]
    db.run("TRUNCATE st_log")
    assert rows(db.run("SELECT count(*) FROM st_log")) == [(0,)]
    db.run("PREPARE p AS SELECT $1 + 1 AS y")
    assert rows(db.run("EXECUTE p(41)")) == [(42,)]
    db.run("DEALLOCATE p")
    db.run("SET work_mem = '4MB'")
    assert rows(db.run("SHOW work_mem")) == [("4MB",)]
    assert "Scan" in "".join(r[0] for r in db.run("EXPLAIN SELECT * FROM st_kind").collect())
    db.run("DROP TABLE st_log")
    with pytest.raises(ValueError):
        db.run("DROP TABLE st_log")
