"""Jaccard join of documents on word shingles with signature trees.

A signature tree's leaves hold the token bitmaps of documents; inner nodes hold the OR of their
children's bitmaps and the range of their set sizes.  Two trees are traversed together, and a pair of
nodes goes when even their largest possible overlap cannot reach the threshold.  Documents reach a
common tree only if the prefix filter lets them link at all:

1.  Every document gives the smallest third of its shingle hashes.  Linked documents of n and m
    shingles share at least 1/12 of the smaller set among these, so a document with too few hashes
    that another has too links with nothing.  This leaves the documents with near copies.
2.  Equal sets are one class.  Classes that share such a hash, directly or through others, form a
    block; every link lies inside one block.
3.  The tree of a block is joined with itself.  In a block too large for one tree, documents of an
    equal smallest hash meet first, in three rounds of other hashes.  What then still has three
    quarters of its shingles in other components of its block is dealt into blocks again, by the
    prefix filter with the rarest shingles first.  Those of them that are too large for one tree are
    put into chunks, and the trees of any two chunks are joined.  Pairs that are already connected
    are skipped: only components count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, groups, narrow_batches, slices, small
from .words import Words, mix, pieces

SHINGLE = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents and shingles of a chunk, about.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 19
#: Rounds in which the documents of large blocks meet those of an equal smallest (salted) hash, before the exact last step.
ROUNDS = 3
LEAF, FAN = 16, 8
#: A table of ids is broadcast up to this many rows (a few ten MB).
ID_ROWS = 500_000


def overlap_needed(n):
    return -(-PERCENT * n // 100)


def _extra(n):
    """The extra prefix elements, which linked documents share at least (of the smaller set)."""
    return np.minimum(np.maximum(1, n // 12), overlap_needed(n))


def prefix_size(n):
    return np.where(n > 0, n - overlap_needed(n) + _extra(n), 0)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, data, offs in pieces(column):
        doc, h = Words(data, offs).shingles(size, short=True)
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        at = np.searchsorted(doc, np.arange(b - a + 1))
        for k in range(b - a):
            yield np.unique(h[at[k] : at[k + 1]])


class Links:
    """Union-find over the rows of one chunk or pair of chunks."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


class SignatureTree:
    """rows: positions of documents, ordered by size and smallest hash; levels from documents up to one root."""

    def __init__(self, rows: np.ndarray, sets: list[np.ndarray], bits: int):
        n = np.array([len(sets[r]) for r in rows], np.int64)
        head = np.array([sets[r][0] if len(sets[r]) else 0 for r in rows], np.uint64)
        order = np.lexsort((head, n))
        self.rows, n = rows[order], n[order]
        maps = np.zeros((len(n), bits // 8), np.uint8)
        for k, r in enumerate(self.rows):
            at = (mix(sets[r]) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[k], at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        maps = maps.view(np.uint64)
        spare = n - np.bitwise_count(maps).sum(1, dtype=np.int64)  # hashes that share a bit
        self.levels = [(n, n, spare, maps, 1)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            lo, hi, spare, maps, _ = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at), np.bitwise_or.reduceat(maps, at, axis=0), fan))
            fan = FAN


def _possible(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes of two levels can hold a link: by size range, then by largest overlap."""
    (lo1, hi1, sp1, m1, _), (lo2, hi2, sp2, m2, _) = x, y
    least = -(-PERCENT * (lo1[i] + lo2[j]) // (100 + PERCENT))
    ok = (100 * hi1[i] >= PERCENT * lo2[j]) & (100 * hi2[j] >= PERCENT * lo1[i]) & (np.minimum(hi1[i], hi2[j]) >= least)
    out = np.flatnonzero(ok)
    step = max(1, (1 << 22) // m1.shape[1])
    keep = []
    for a in range(0, len(out), step):
        k = out[a : a + step]
        shared = np.bitwise_count(m1[i[k]] & m2[j[k]]).sum(1, dtype=np.int64) + np.minimum(sp1[i[k]], sp2[j[k]])
        keep.append(k[shared >= least[k]])
    return np.concatenate(keep) if keep else out


def _expand(i, j, fan, n1, n2):
    """All pairs of children of node pairs."""
    a, b = np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij")
    x, y = (i[:, None] * fan + a.ravel()).ravel(), (j[:, None] * fan + b.ravel()).ravel()
    ok = (x < n1) & (y < n2)
    return x[ok], y[ok]


def tree_join(one: SignatureTree, two: SignatureTree, sets: list[np.ndarray], links: Links) -> None:
    """Connect the linked documents of two trees (or of one with itself), by depth-first dual traversal."""
    same = one is two
    height = max(len(one.levels), len(two.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    stack = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        x, y = level(one, k), level(two, k)
        if k == 0:
            roots = links.roots()
            far = np.flatnonzero(roots[one.rows[i]] != roots[two.rows[j]])
            i, j = i[far], j[far]
        ok = _possible(x, y, i, j)
        i, j = i[ok], j[ok]
        if k == 0:
            for a, b in zip(one.rows[i].tolist(), two.rows[j].tolist()):
                if links.find(a) != links.find(b):
                    s, t = sets[a], sets[b]
                    at = np.searchsorted(s, t)
                    at[at == len(s)] = 0
                    both = int((s[at] == t).sum())
                    if 100 * both >= PERCENT * (len(s) + len(t) - both):
                        links.join(a, b)
            continue
        f1, f2 = (x[4] if k < len(one.levels) else 1), (y[4] if k < len(two.levels) else 1)
        n1, n2 = len(level(one, k - 1)[0]), len(level(two, k - 1)[0])
        fan = max(f1, f2)
        # node pairs are taken some at a time, the most alike in size first
        step = max(1, 16_384 // (fan * fan))
        for a in range(0, len(i), step):
            p, q = i[a : a + step], j[a : a + step]
            if f1 == f2:
                p, q = _expand(p, q, fan, n1, n2)
            elif f1 > f2:  # the other tree is lower: only this side has children
                p, q = (p[:, None] * f1 + np.arange(f1)).ravel(), np.repeat(q, f1)
                q, p = q[p < n1], p[p < n1]
            else:
                q, p = (q[:, None] * f2 + np.arange(f2)).ravel(), np.repeat(p, f2)
                p, q = p[q < n2], q[q < n2]
            if same:
                keep = p <= q if k > 1 else p < q
                p, q = p[keep], q[keep]
            if len(p):
                stack.append((k - 1, p, q))


def _bits(sets: list[np.ndarray]) -> int:
    most = max((len(s) for s in sets), default=1)
    return int(min(max(256, 1 << int(4 * most - 1).bit_length()), 1 << 15))


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) from rows (keys..., doc_id, comp, side, h): trees of each group; sides 0 and 1 are joined, side 0 alone with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in groups(batches, len(keys)):
            ids, comp, side = cols[-4], cols[-3], np.array(cols[-2])
            sets = [np.frombuffer(h, np.uint64) for h in cols[-1]]
            bits, links, first = _bits(sets), Links(len(ids)), {}
            for k, c in enumerate(comp):
                links.join(first.setdefault(c, k), k)
            before = links.roots()
            one = SignatureTree(np.flatnonzero(side == 0), sets, bits) if (side == 0).any() else None
            two = SignatureTree(np.flatnonzero(side == 1), sets, bits) if (side == 1).any() else one
            if one is not None and (two is not one or cols[-2][0] == 0 and not (side == 1).any()):
                tree_join(one, two, sets, links)
            a, b = [], []
            for k, r in enumerate(links.roots().tolist()):
                if r != before[k] or before[k] != k and comp[k] != comp[r]:
                    a.append(ids[r])
                    b.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cols = [*keys, "doc_id", "comp", "side", "h"]
    rows = rows.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, known, open): n shingles; of the prefix, how many hashes other documents of the batch have, and the rest.

    The rest also holds, once for each batch, every hash that the batch has several times, so that
    a hash that very many documents have is shuffled once for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = list(shingle_sets(b.column(1)))
            n = np.array([len(s) for s in sets], np.int64)
            size = prefix_size(n)
            flat = np.concatenate([s[:p] for s, p in zip(sets, size)]) if len(sets) else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            f = flat[order]
            new = np.concatenate([[True], f[1:] != f[:-1]]) if len(f) else np.zeros(0, bool)
            end = np.concatenate([new[1:], [True]]) if len(f) else new
            alone, first = np.zeros(len(f), bool), np.zeros(len(f), bool)
            alone[order] = new & end
            first[order] = new
            known = np.bincount(row[~alone], minlength=len(sets))
            opened = np.bincount(row[first], minlength=len(sets))
            values = flat[first].view(np.int64)
            offs = np.concatenate([[0], np.cumsum(opened)]).astype(np.int32)
            flags = pa.ListArray.from_arrays(pa.array(offs), pa.array(alone[first]))
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(known, pa.int64()), lists, flags], names=["doc_id", "n", "known", "open", "alone"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, known bigint, open array<bigint>, alone array<boolean>")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key1, key2, h, m): the sorted shingle hashes as bytes, 128 bits of hash over them, smallest salted hashes."""
    salts = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, ROUNDS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = list(shingle_sets(b.column(1)))
            least = [[int(mix(s ^ salt).min().view(np.int64)) if len(s) else 0 for salt in salts] for s in sets]
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "h", "m"])

    out = docs.mapInArrow(run, "doc_id bigint, n bigint, h binary, m array<bigint>")
    return out.select("doc_id", "n", F.xxhash64("h").alias("key1"), F.xxhash64(F.lit(1), "h").alias("key2"), "h", "m")


def _block_edges(sets: DataFrame) -> DataFrame:
    """(kind, x, y): kind 0, an edge between classes of one batch that share a prefix hash; kind 1, hash x of class y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(h.as_py(), np.uint64) for h in b.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            size = n - overlap_needed(n) + 1  # linked sets share one of these
            flat, row = np.concatenate([s[:p] for s, p in zip(sets, size)]), np.repeat(np.arange(len(sets)), size)
            order = np.lexsort((ids[row], flat))
            f, r = flat[order], row[order]
            new = np.concatenate([[True], f[1:] != f[:-1]]) if len(f) else np.zeros(0, bool)
            lead = r[np.flatnonzero(new)][np.cumsum(new) - 1] if len(f) else r
            pairs = np.unique(np.column_stack([lead[~new], r[~new]]), axis=0)
            links, a, c = Links(len(sets)), [], []
            for x, y in pairs.tolist():
                if links.find(x) != links.find(y):
                    links.join(x, y)
                    a.append(ids[x])
                    c.append(ids[y])
            x = np.concatenate([np.array(a, np.int64), f[new].view(np.int64)])
            y = np.concatenate([np.array(c, np.int64), ids[r[new]]])
            kind = np.concatenate([np.zeros(len(a), np.int32), np.ones(int(new.sum()), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], names=["kind", "x", "y"])

    return sets.select("doc_id", "h").mapInArrow(run, "kind int, x bigint, y bigint")


def _shingles(own: DataFrame, lab: DataFrame) -> DataFrame:
    """(doc_id, block, comp, n, x): every shingle hash of the documents of lab (doc_id, block, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = pa.array([np.frombuffer(h.as_py(), np.int64) for h in b.column(3)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), lists], names=["doc_id", "block", "comp", "n", "x"])

    rows = own.join(small(lab, ID_ROWS), "doc_id").select("doc_id", "block", "comp", "h", "n")
    rows = rows.mapInArrow(run, "doc_id bigint, block bigint, comp bigint, n bigint, x array<bigint>")
    return rows.select("doc_id", "block", "comp", "n", F.explode("x").alias("x"))


def _met(rows: DataFrame) -> DataFrame:
    """The rows whose hash stands in several components of its block, with the number k of rows that have it there."""
    w = Window.partitionBy("block", "x")
    return rows.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w), "k": F.count("*").over(w)}).where("lo <> hi").drop("lo", "hi")


def _contested(own: DataFrame, lab: DataFrame) -> DataFrame:
    """The rows of lab (doc_id, block, comp) that can link with another component of their block.

    A document that links with one has three quarters of its shingles in other components.
    """
    met = _met(_shingles(own, lab)).groupBy("doc_id", "n").agg(F.count("*").alias("met")).where(F.col("met") * 100 >= F.col("n") * PERCENT)
    return lab.join(met.select("doc_id").distinct(), "doc_id", "left_semi")


def _rare_edges(own: DataFrame, lab: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the documents of lab that can link with another component of their block.

    The prefix filter again, with the rarest shingles first: those that no other component has count
    as the rarest, then go those that few documents of lab have.  Linked documents share the first of
    their common shingles, and at least three quarters of each set stand from there on.
    """
    need = F.ceil(F.col("n") * PERCENT / 100)
    doc = Window.partitionBy("doc_id", "n")
    rows = _met(_shingles(own, lab)).withColumns({"met": F.count("*").over(doc), "at": F.row_number().over(doc.orderBy("k", "x"))})
    rows = rows.where(F.col("at") <= F.col("met") - need + 1).select("doc_id", "block", "comp", "x")
    w = Window.partitionBy("block", "x")
    rows = rows.withColumns({"a": F.min("doc_id").over(w), "lo": F.min("comp").over(w), "hi": F.max("comp").over(w)})
    return rows.where("lo <> hi AND a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Words are runs of anything but the ASCII white space, A-Z lowered; a document's set is its
    distinct five-word shingles, or its whole sequence as one if it has fewer words.  Null,
    empty and blank texts have no shingles and link with nothing.  Documents link when
    100 * intersection >= 75 * union; component_id is the smallest doc_id that links reach.
    Rows that share a doc_id are one vertex; a null doc_id has a null component.  No link is lost:
    all filters are exact, and sets are compared whole (as 64-bit hashes of shingles).
    The session's Arrow batches are lowered to 1,024 rows, which changes no result.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = scratch.put(_prefixes(docs))
    tokens = base.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.arrays_zip("open", "alone")).alias("t")).select("doc_id", F.col("t.open").alias("x"), F.col("t.alone").alias("alone"))
    met = tokens.withColumn("c", F.count("*").over(Window.partitionBy("x"))).where("alone AND c > 1").groupBy("doc_id").agg(F.count("*").alias("met"))
    least = F.ceil(F.col("n") * PERCENT / 100)
    need = F.least(F.greatest(F.lit(1), F.floor(least / 12)), least)
    alive = base.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "known").join(met, "doc_id", "left").where(F.col("known") + F.coalesce("met", F.lit(0)) >= need)
    alive = scratch.put(alive.select("doc_id").distinct())
    sizes_of = scratch.put(base.select("doc_id", F.col("n").alias("n_shingles")))
    scratch.drop(base)
    keys = scratch.put(_sets(docs.join(small(alive, ID_ROWS), "doc_id", "left_semi")).drop("h", "m"))
    # only sets that stand more than once need their class; the copies of one need no common task
    classes = keys.groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    classes = scratch.put(classes)
    member = keys.join(small(classes, ID_ROWS), ["n", "key1", "key2"], "left")
    member = scratch.put(member.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct())
    reps = member.select(F.col("rep").alias("doc_id")).distinct()
    # the sets of one document of each class; the rows of a repeated doc_id all stay
    own = scratch.put(_sets(docs.join(small(reps, ID_ROWS), "doc_id", "left_semi")).select("doc_id", "n", "h", "m"))
    near = _block_edges(own)
    opened = near.where("kind = 1").select("x", "y").withColumn("m", F.min("y").over(Window.partitionBy("x")))
    edges = near.where("kind = 0").selectExpr("x AS a", "y AS b").unionByName(opened.where("m <> y").selectExpr("m AS a", "y AS b").distinct())
    edges = scratch.put(edges)  # else each task would hold two Python workers at once
    block = components(spark, edges, scratch).withColumnRenamed("id", "doc_id").withColumnRenamed("comp", "block")
    sized = own.select("doc_id", "n").join(block, "doc_id")
    sizes = sized.groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("k") / CHUNK), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int")
    sizes = sizes.where("k > 1").select("block", chunks.alias("chunks"))
    placed = scratch.put(sized.join(small(sizes), "block").select("doc_id", "block", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk")).distinct())
    scratch.drop()
    sets_in = lambda p: own.select("doc_id", "h").join(small(p, ID_ROWS), "doc_id")
    whole = placed.where("chunks = 1").select("doc_id", "block", F.col("doc_id").alias("comp"), F.lit(0).alias("side"))
    edges = scratch.put(_joined(sets_in(whole), ["block"]))
    lab = scratch.put(placed.where("chunks > 1").select("doc_id", "block", F.col("doc_id").alias("comp")))
    if lab.limit(1).count():
        for r in range(ROUNDS):
            met = own.select("doc_id", F.col("m")[r].alias("m")).join(small(lab, ID_ROWS), "doc_id")
            parts = met.groupBy("block", "m").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"), F.count_distinct("comp").alias("c")).where("c > 1").drop("c")
            met = scratch.put(met.join(parts, ["block", "m"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(r)), F.col("parts")).cast("int")).withColumn("side", F.lit(0)))
            edges = scratch.put(edges.unionByName(_joined(sets_in(met), ["block", "m", "part"])))
            comp = components(spark, edges, scratch).withColumnRenamed("id", "doc_id")
            lab = scratch.put(lab.select("doc_id", "block").join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")))
        lab = scratch.put(_contested(own, lab))
        # by their rarest shingles these fall into blocks of their own, few of which are too large for one tree
        block = components(spark, scratch.put(_rare_edges(own, lab)), scratch).withColumnRenamed("id", "doc_id").withColumnRenamed("comp", "block")
        lab = scratch.put(lab.select("doc_id", "comp").join(block, "doc_id").select("doc_id", "block", "comp"))
        left = lab.join(own.select("doc_id", "n"), "doc_id").groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
        lab = scratch.put(lab.join(small(left.select("block", chunks.alias("chunks"))), "block").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")))
        same = lab.select("doc_id", "block", "comp", F.col("chunk").alias("c1"), F.col("chunk").alias("c2"), F.lit(0).alias("side"))
        cells = lab.select("doc_id", "block", "comp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).where("chunk <> other")
        cells = cells.select("doc_id", "block", "comp", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))
        e3 = scratch.put(_joined(sets_in(same.unionByName(cells)), ["block", "c1", "c2"]))
        edges = edges.unionByName(e3)
    comp = components(spark, edges.unionByName(member.where("doc_id <> rep").selectExpr("rep AS a", "doc_id AS b")), scratch)
    scratch.drop(own)
    out = sizes_of.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest doc_id of their component; rows with a null doc_id stay."""
    gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
