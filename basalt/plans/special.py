"""Vector search, full-text search, DML as transforms, incremental views, functions defined by users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fts as T
from ..functions import vectors as V
from ..operators import dml as D
from ..operators.routines import SqlFunctions
from ..sources import catalog_views as C
from ..streaming.incremental import IncrementalView
from .catalog import register, table


def _query_vector(spark, sf_dir) -> list[float]:
    """One row by key: the constant of the search, as a client would pass it."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]


_KNN = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


@register("knn_cosine", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_KNN}), 6) AS d FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_KNN}), vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.knn(e, "embedding", _query_vector(spark, sf_dir), 10, "cosine", "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


@register("knn_l2_filtered", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_KNN}), 6) AS d FROM embeddings WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], {_KNN}), vec_id LIMIT 5")
def knn_l2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", "embedding")
    return V.knn(e, "embedding", _query_vector(spark, sf_dir), 5, "l2", "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


@register(
    "hybrid_rrf",
    f"""WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], {_KNN}), 9), vec_id) AS r FROM embeddings), w AS (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 7919) % 1009, vec_id) AS r FROM embeddings)
    SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM v WHERE r <= 50 UNION ALL SELECT * FROM w WHERE r <= 50) GROUP BY vec_id""",
)
def hybrid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    e = e.withColumn("d", F.round(V.cosine_distance(F.col("embedding"), q), 9)).withColumn("t", (F.col("vec_id") * 7919) % 1009)
    return V.fuse_ranked([e.select("vec_id", "d"), e.select("vec_id", "t")], "vec_id", [F.col("d"), F.col("t")], 60, 50).withColumn("score", F.round("score", 9))


@register("fts_match_rank", "SELECT p_partkey, regexp_matches(lower(p_type), '\\bsteel\\b') AND NOT regexp_matches(lower(p_type), '\\bsmall\\b') AS m, CASE WHEN regexp_matches(lower(p_type), '\\bsteel\\b') THEN 0.060793 ELSE 0 END AS r FROM part")
def fts_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", T.to_tsvector(F.col("p_type"), "simple").alias("v"), F.lit("'steel'").alias("q"))
    q = F.lit("'steel' & !'small'")
    return p.select("p_partkey", T.ts_match(F.col("v"), q).alias("m"), F.round(T.ts_rank(F.col("v"), F.col("q")), 6).cast("double").alias("r"))


@register("fts_vectors")
def fts_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = T.to_tsvector(F.col("text"), "english")
    return d.select("doc_id", F.length(v).alias("size"), T.numnode(T.plainto_tsquery(F.substring("text", 1, 40), "english")).alias("nodes"))


def _split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1000, 2))


_T = "(SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0)"
_S = "(SELECT c_custkey, c_nationkey, round(c_acctbal + 1000, 2) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


@register("dml_insert_select", f"SELECT * FROM {_T} UNION ALL SELECT c_custkey + 1000000, 0, c_acctbal FROM {_S}")
def insert(spark, sf_dir):
    t, s = _split(spark, sf_dir)
    return D.insert(t, s.select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_acctbal"), {"c_nationkey": F.lit(0)})


@register("dml_upsert_nothing", f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_S} s WHERE NOT EXISTS (SELECT 1 FROM {_T} t WHERE t.c_custkey = s.c_custkey)")
def upsert_nothing(spark, sf_dir):
    return D.upsert(*_split(spark, sf_dir), ["c_custkey"])


@register(
    "dml_upsert_update",
    f"""SELECT t.c_custkey, t.c_nationkey, CASE WHEN s.c_custkey IS NOT NULL AND s.c_acctbal > 0 THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal FROM {_T} t LEFT JOIN {_S} s USING (c_custkey)
    UNION ALL SELECT * FROM {_S} s WHERE NOT EXISTS (SELECT 1 FROM {_T} t WHERE t.c_custkey = s.c_custkey)""",
)
def upsert_update(spark, sf_dir):
    return D.upsert(*_split(spark, sf_dir), ["c_custkey"], {"c_acctbal": F.col("excluded.c_acctbal")}, F.col("excluded.c_acctbal") > 0)


@register("dml_update_from", f"SELECT t.c_custkey, t.c_nationkey, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM {_T} t LEFT JOIN {_S} s USING (c_custkey)")
def update_from(spark, sf_dir):
    t, s = _split(spark, sf_dir)
    return D.update_from(t, s, F.col("t.c_custkey") == F.col("s.c_custkey"), ["c_custkey"], {"c_acctbal": F.col("s.c_acctbal")}).select("c_custkey", "c_nationkey", "c_acctbal")


@register("dml_delete_using", f"SELECT * FROM {_T} t WHERE NOT EXISTS (SELECT 1 FROM {_S} s WHERE s.c_custkey = t.c_custkey AND s.c_acctbal > 3000)")
def delete_using(spark, sf_dir):
    t, s = _split(spark, sf_dir)
    return D.delete_using(t, s, (F.col("t.c_custkey") == F.col("s.c_custkey")) & (F.col("s.c_acctbal") > 3000))


@register(
    "dml_merge",
    f"""SELECT t.c_custkey, CASE WHEN s.c_custkey IS NULL THEN -1 ELSE t.c_nationkey END AS c_nationkey, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM {_T} t LEFT JOIN {_S} s USING (c_custkey) WHERE NOT (s.c_custkey IS NOT NULL AND s.c_acctbal < 500)
    UNION ALL SELECT s.c_custkey, s.c_nationkey, s.c_acctbal FROM {_S} s WHERE s.c_acctbal > 2000 AND NOT EXISTS (SELECT 1 FROM {_T} t WHERE t.c_custkey = s.c_custkey)""",
)
def merge(spark, sf_dir):
    m = D.Merge(["c_custkey"]).when_matched_delete(F.col("s.c_acctbal") < 500).when_matched_update({"c_acctbal": F.col("s.c_acctbal")})
    m.when_not_matched_insert({c: F.col(f"s.{c}") for c in ("c_custkey", "c_nationkey", "c_acctbal")}, F.col("s.c_acctbal") > 2000)
    m.when_not_matched_by_source_update({"c_nationkey": F.lit(-1)})
    return m.apply(*_split(spark, sf_dir))


@register("view_incremental", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND (o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0) AND NOT (o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0)")
def incremental(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    v = IncrementalView([F.col("o_orderkey"), F.col("o_totalprice")], F.col("o_totalprice") > 100000)
    base = o.where("o_orderkey % 5 <> 0")
    return v.apply(v.full(base), inserted=o.where("o_orderkey % 5 = 0 AND o_orderkey % 7 = 0"), deleted=base.where("o_orderkey % 11 = 0"))


@register("udf_sql_function", "SELECT p_partkey, (p_size * 2 + 1) * (p_size * 2 + 1) AS v, length(p_name) + 3 AS w FROM part")
def sql_function(spark, sf_dir):
    f = SqlFunctions()
    f.create("twice_plus", ["x"], "x * 2 + 1")
    f.create("squared", ["y"], "twice_plus(y) * twice_plus(y)")
    f.create("padded", ["s", "n"], "length($1) + $2")
    return f.select(table(spark, sf_dir, "part"), "p_partkey", "squared(p_size) AS v", "padded(p_name, 3) AS w")


@register("catalog_tables", "SELECT 'nation' AS table_name, 'VIEW' AS table_type UNION ALL SELECT 'region', 'VIEW'")
def catalog_tables(spark, sf_dir):
    for t in ("nation", "region"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return C.tables(spark).where("table_name IN ('nation', 'region')").select("table_name", "table_type")


@register("events_tumbling_windows", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    from ..functions.temporal import date_bin

    day = date_bin(86_400_000_000, F.col("ts"), "2000-01-01 00:00:00").alias("day")
    return table(spark, sf_dir, "events").groupBy("event_type", day).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
