"""Embedding near-duplicates by iterative quantisation, multi-index Hamming tables and exact reranking.

Unit vectors are centred, turned to their principal axes and rotated so that their signs are close to
the vectors (Gong & Lazebnik): balanced binary codes that keep neighbours together.  A code is cut
into substrings, one table each; two vectors within fewer bits than there are tables agree in one
whole substring.  Vectors of one label that meet in a table are reranked by the cosine of the original
vectors in double precision.  A pair that meets in several tables counts in the first only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, groups

COSINE = 0.98
#: Vectors that the rotations are learnt on at most, by hash of the id.  Every vector is indexed.
SAMPLE = 8192
ITERATIONS = 30
#: Chance of meeting in some table that a pair at the threshold is given (by the angle of a sign change).
RECALL = 0.995
#: Tables up to which their number makes up for codes that disagree more than planned.
MOST = 48
#: Vectors of a bucket that are compared in one piece; larger buckets are split into pairs of pieces.
CHUNK = 256


class Rotations:
    """Learnt rotations for one dimension; several give codes longer than the dimension."""

    def __init__(self, x: np.ndarray, bits: int, seed: int = 7):
        d = x.shape[1]
        self.mean = x.mean(0) if len(x) else np.zeros(d)
        z = x - self.mean
        if len(x) > 1:
            values, axes = np.linalg.eigh(z.T @ z / len(x))
            axes = axes[:, np.argsort(-values)]
        else:
            axes = np.eye(d)
        z = z @ axes
        rng = np.random.default_rng(seed)
        parts = []
        for _ in range(-(-bits // d)):
            r, _ = np.linalg.qr(rng.standard_normal((d, d)))
            for _ in range(ITERATIONS if len(x) > 1 else 0):
                b = np.where(z @ r >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(b.T @ z)
                r = (u @ v).T  # the rotation that brings the vectors nearest to their codes
            parts.append(axes @ r)
        self.matrix = np.concatenate(parts, 1)[:, :bits]

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix >= 0

    def substrings(self, x: np.ndarray, tables: int, bits: int) -> np.ndarray:
        on = self.signs(x).reshape(len(x), tables, bits)
        return (on * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(np.int32)


def plan(n: int) -> tuple[int, int]:
    """(tables, bits of each) for n vectors of one label: as many buckets as vectors, tables for the recall."""
    bits = min(max(math.ceil(math.log2(max(n, 2))), 4), 24)
    same = (1 - math.acos(COSINE) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - same))), bits


def learn(x: np.ndarray, n: int, pairs: int = 2048) -> tuple[Rotations, int, int]:
    """(rotations, tables, bits of each) that reach the recall on pairs at COSINE around unit vectors x.

    Centring widens the angle between vectors of a common direction, so that codes disagree more
    than plan() reckons: there, more tables, and beyond MOST of them fewer bits, make up for it.
    """
    tables, bits = plan(n)
    model = Rotations(x, tables * bits)
    sample, x = x, x[:pairs]
    if not len(x) or x.shape[1] < 2:
        return model, tables, bits
    e = np.random.default_rng(11).standard_normal(x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    y = COSINE * x + math.sqrt(1 - COSINE**2) * e / np.sqrt((e * e).sum(1, keepdims=True))
    agree = (model.signs(x) == model.signs(y)).mean(1)
    recall = lambda t, b: (1 - (1 - agree**b) ** t).mean()
    most, b = max(MOST, tables), bits
    while b > 1 and recall(most, b) < RECALL:
        b -= 1
    t = tables
    while t < most and recall(t, b) < RECALL:
        t += 1
    return (model if (t, b) == (tables, bits) else Rotations(sample, t * b)), t, b


def _unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # norms neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors link when label and dimension are equal and the cosine is at least 0.98.  A null label,
    a null or zero vector, or null or non-finite components link with nothing.  Equal vectors of a
    label are one class: their links are counted without pairs.  Rows sharing a vec_id are
    one vertex of the components.  A null vec_id has no links and a null component.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    keyed = v.where(fine).select("vec_id", "label", F.size("x").alias("dim"), F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"), "x")
    key = ["label", "dim", "k1", "k2"]
    classes = keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = scratch.put(classes)
    member = scratch.put(keyed.select("vec_id", *key).join(classes.drop("x"), key).select("vec_id", "rep", "copies"))
    reps = classes.select(F.col("rep").alias("vec_id"), "copies", "label", "dim", "x")
    counts = reps.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # a row for each dimension
    models = {}
    for r in counts:
        sample = reps.where(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "x").toArrow()
        models[r.dim] = learn(_unit(sample.column("x").combine_chunks()), r.n)
    shared = spark.sparkContext.broadcast(models)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                model, tables, bits = shared.value[int(dim)]
                x = _unit(part.column(3))
                codes = model.substrings(x, tables, bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(4), pa.array(list(codes), pa.list_(pa.int32())), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["vec_id", "copies", "dim", "label", "codes", "u"],
                )

    kind = dict(reps.dtypes)["label"]
    coded = scratch.put(reps.select("vec_id", "copies", "dim", "x", "label").mapInArrow(code, f"vec_id bigint, copies bigint, dim int, label {kind}, codes array<int>, u binary"))
    bucket = ["dim", "label", "t", "c"]
    rows = coded.select("vec_id", "dim", "label", F.posexplode("codes").alias("t", "c"))
    full = rows.groupBy(*bucket).agg(F.count("*").alias("k")).where("k > 1").withColumn("chunks", F.ceil(F.col("k") / CHUNK).cast("int"))
    placed = rows.join(full, bucket).select("vec_id", *bucket, "chunks", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"))
    cells = placed.select("vec_id", *bucket, "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cells = cells.select("vec_id", *bucket, F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    keys = [*bucket, "c1", "c2"]
    cells = cells.join(coded.select("vec_id", "copies", "codes", "u"), "vec_id").select(*keys, "vec_id", "copies", "side", "codes", "u")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[int] = []
        one: list[int] = []
        two: list[int] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["kind", "a", "b"])
            for x in (kinds, one, two):
                x.clear()
            return out

        for cols in groups(batches, len(keys)):
            t, ids = cols[2][0], np.array(cols[6])
            if len(ids) < 2:
                continue
            copies, side = np.array(cols[7]), np.array(cols[8])
            codes, u = np.array(cols[9]), np.frombuffer(b"".join(cols[10]), np.float64).reshape(len(ids), -1)
            own = cols[4][0] == cols[5][0]
            left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            links, up = np.zeros(len(ids), np.int64), list(range(len(ids)))

            def find(x: int, up: list[int] = up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for a in range(0, len(left), 512):
                p = left[a : a + 512]
                i, j = np.nonzero(u[p] @ u[right].T >= COSINE)
                i, j = p[i], right[j]
                if own:
                    i, j = i[i < j], j[i < j]
                if t:
                    for k in range(0, len(i), 1 << 16):  # met in an earlier table: counted there
                        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        fresh = ~(codes[x, :t] == codes[y, :t]).any(1)
                        i[k : k + (1 << 16)], j[k : k + (1 << 16)] = np.where(fresh, x, -1), np.where(fresh, y, -1)
                    i, j = i[i >= 0], j[j >= 0]
                links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                for x, y in zip(i.tolist(), j.tolist()):
                    x, y = find(x), find(y)
                    if x != y:
                        up[max(x, y)] = min(x, y)
            for x in np.flatnonzero(links).tolist():
                kinds.append(0)
                one.append(int(ids[x]))
                two.append(int(links[x]))
                if (r := find(x)) != x:
                    kinds.append(1)
                    one.append(int(ids[r]))
                    two.append(int(ids[x]))
            if len(kinds) > 50_000:
                yield flush()
        yield flush()

    found = scratch.put(cells.repartition(*keys).sortWithinPartitions(*keys, "vec_id").mapInArrow(rerank, "kind int, a bigint, b bigint"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    edges = found.where("kind = 1").select("a", "b").unionByName(member.where("vec_id <> rep").selectExpr("rep AS a", "vec_id AS b"))
    comp = components(spark, edges, scratch).withColumnRenamed("id", "vec_id")
    per = member.join(links, "rep", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = v.select("vec_id").join(per, "vec_id", "left").join(comp, "vec_id", "left")
    component = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
