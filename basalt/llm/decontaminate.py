"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Words (runs of letters and digits, lower-cased) are the symbols.  An item of n words is leaked where a
stretch of a text is within floor(0.25 n) word edits of it.  Windows of the item's length are looked
at where the q-gram lemma allows a match: that many edits leave a known number of the item's
three-word runs intact on nearly one diagonal, so no match is lost there.  Each such window and
the items are walked at random (CGK): the walk stays or steps on by a random bit of the current
word, which turns a small edit distance into a small Hamming distance.  Repetitions compare a few
sampled positions of fresh walks; a window that agrees in one of them is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import BASE, Words, mix, pieces

#: Word edits allowed, as a share of the item's words.
EDITS = 0.25
#: Repetitions and sampled positions in each: a window at the largest distance agrees at one position
#: in two or more, so that 48 repetitions of 3 find it with probability above 0.99.
REPEATS, SAMPLED = 48, 3
#: Items that are broadcast at a time; larger benchmarks are worked off in blocks of this many.
BLOCK = 20_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for the two-byte Latin letters (A-Z is lowered in hashing)."""
    up = np.zeros(len(data), bool)
    up[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(up, data + np.uint8(32), data)


def edit_infix(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(smallest edits between item and any stretch of text, end of the first such stretch)."""
    prev = np.zeros(len(text) + 1, np.int64)  # a stretch may start anywhere
    steps = np.arange(len(text) + 1)
    for k, x in enumerate(item, 1):
        cur = np.empty_like(prev)
        cur[0] = k
        cur[1:] = np.minimum(prev[1:] + 1, prev[:-1] + (text != x))
        prev = np.minimum.accumulate(cur - steps) + steps  # insertions, left to right
    end = int(prev.argmin())
    return int(prev[end]), end


class Leaks:
    """Items with their seeds and sampled embeddings; find() works on the words of one piece."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for i, text in items:
            data = fold(np.frombuffer((text or "").encode(), np.uint8))
            w = Words(data, np.array([0, len(data)]), _WORD).hash
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        n = np.array([len(w) for w in self.words], np.int64)
        self.size, self.edits = n, np.floor(EDITS * n).astype(np.int64)
        self.q = np.minimum(3, np.maximum(1, n // (self.edits + 1)))
        self.need = np.maximum(1, n - self.q + 1 - self.q * self.edits)
        self.seeds = {}
        for q in np.unique(self.q):
            rows = [(h, k, p) for k in np.flatnonzero(self.q == q) for p, h in enumerate(Words.shingles(_Seq(self.words[k]), int(q))[1])]
            h = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            likely = np.zeros(1 << 20, bool)
            likely[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[int(q)] = h[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order], likely
        rng = np.random.default_rng(20240229)
        self.longest = int(n.max()) if len(n) else 0
        self.salt = rng.integers(1, 2**63, size=(3 * self.longest, REPEATS), dtype=np.uint64)
        self.at = rng.random((REPEATS, SAMPLED))
        self.codes = np.zeros((len(n), REPEATS), np.uint64)
        for a in range(0, len(n), 256):
            k = np.arange(a, min(a + 256, len(n)))
            grid = np.zeros((len(k), self.longest + 1), np.uint64)
            for r, j in enumerate(k):
                grid[r, : n[j]] = self.words[j]
            self.codes[k] = self.embed(grid, n[k])

    def embed(self, grid: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of the sampled positions of every walk over the rows of grid (zero after `size` words)."""
        n = len(grid)
        rows = np.arange(n)[:, None]
        at = np.zeros((n, REPEATS), np.int64)
        want = (self.at[None] * (3 * size)[:, None, None]).astype(np.int64)
        code = np.zeros((n, REPEATS, SAMPLED), np.uint64)
        for j in range(3 * int(size.max())):
            symbol = grid[rows, np.minimum(at, size[:, None])]
            hit = want == j
            if hit.any():
                code = np.where(hit, symbol[:, :, None], code)
            at += (mix(symbol ^ self.salt[j]) & np.uint64(1)).astype(np.int64)
        with np.errstate(over="ignore"):
            out = np.zeros((n, REPEATS), np.uint64)
            for s in range(SAMPLED):
                out = mix(out * BASE + code[:, :, s])
        return out

    def find(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(row of the piece, item, edits, end word in the row): the best stretch for each pair."""
        docs, items, diag = [], [], []
        for q, (table, item, pos, likely) in self.seeds.items():
            if not len(table) or not len(w.hash):
                continue
            ok = np.zeros(len(w.hash), bool)
            if len(ok) >= q:
                ok[: len(ok) - q + 1] = w.doc[: len(ok) - q + 1] == w.doc[q - 1 :]
            start = np.flatnonzero(ok)
            _, h = w.shingles(q)
            maybe = np.flatnonzero(likely[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(table, h[maybe], "left"), np.searchsorted(table, h[maybe], "right")
            n = hi - lo
            got = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(start[maybe], n)
            docs.append(w.doc[p])
            items.append(item[got])
            diag.append(p - w.bounds[w.doc[p]] - pos[got])
        if not docs or not sum(map(len, docs)):
            return []
        doc, item, diag = map(np.concatenate, (docs, items, diag))
        group = doc * len(self.ids) + item
        order = np.lexsort((diag, group))
        group, diag = group[order], diag[order]
        item = group % len(self.ids)
        width = int(max(diag.max() - diag.min(), 0)) + 2 * self.longest + 2
        rank = np.unique(group, return_inverse=True)[1].astype(np.int64)
        key = rank * width + (diag - diag.min())
        # enough seeds within `edits` diagonals from here on, or this diagonal is among such ones
        first = np.searchsorted(key, key + self.edits[item], "right") - np.arange(len(key)) >= self.need[item]
        mark = np.zeros(len(key) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(first), 1)
        np.add.at(mark, np.searchsorted(key, key[first] + self.edits[item[first]], "right"), -1)
        use = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        new = np.flatnonzero(np.concatenate([[True], key[use][1:] != key[use][:-1]])) if len(use) else use
        use = use[new]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        near: dict[tuple[int, int], list[int]] = {}
        for a in range(0, len(use), 256):
            k = use[a : a + 256]
            it, d = item[k], group[k] // len(self.ids)
            grid = np.zeros((len(k), self.longest + 1), np.uint64)
            for r, (i, row, s) in enumerate(zip(it, d, diag[k])):
                lo, hi = w.bounds[row], w.bounds[row + 1]
                s = max(0, min(int(s), int(hi - lo - self.size[i])))
                part = w.hash[lo + s : min(lo + s + self.size[i], hi)]
                grid[r, : len(part)] = part
            agree = (self.embed(grid, self.size[it]) == self.codes[it]).any(1)
            for i, row, s in zip(it[agree].tolist(), d[agree].tolist(), diag[k][agree].tolist()):
                near.setdefault((row, i), []).append(s)
        for (row, i), starts in near.items():  # stretches that may overlap are verified as one
            lo, hi, e, n = int(w.bounds[row]), int(w.bounds[row + 1]), int(self.edits[i]), int(self.size[i])
            starts.sort()
            cuts = [0, *(j for j in range(1, len(starts)) if starts[j] - starts[j - 1] > n), len(starts)]
            for x, y in zip(cuts, cuts[1:]):
                x, y = max(lo, lo + starts[x] - e), min(hi, lo + starts[y - 1] + n + 2 * e)
                edits, end = edit_infix(self.words[i], w.hash[x:y])
                if edits <= e:
                    best[row, i] = min(best.get((row, i), (edits, 1 << 60)), (edits, x - lo + end))
        return [(row, i, n, end) for (row, i), (n, end) in sorted(best.items())]


class _Seq:
    """One word sequence in the shape that Words.shingles reads."""

    def __init__(self, h: np.ndarray):
        self.hash, self.doc = h, np.zeros(len(h), np.int64)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, similarity, end_word): one row for each document and item that it leaks.

    Null and empty texts and items match nothing.  Items with equal texts are each reported; rows
    that share a doc_id count as one document.  Items are broadcast in blocks of at most BLOCK,
    whole documents stay where they are: no shuffle of texts.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where("item_id IS NOT NULL")
    blocks = max(1, -(-items.count() // BLOCK))
    schema = "doc_id bigint, item_id bigint, edits int, similarity double, end_word bigint"

    def search(k: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(sorted((r.item_id, r.t or "") for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = Leaks(shared.value)
            for b in slices(batches):
                rows: list[tuple] = []
                ids = b.column(0)
                for a, _, data, offs in pieces(b.column(1)):
                    for row, i, n, end in leaks.find(Words(fold(data), offs, _WORD)):
                        rows.append((ids[a + row].as_py(), leaks.ids[i], n, 1 - n / int(leaks.size[i]), end))
                cols = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "edits", "similarity", "end_word"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, map(search, range(blocks)))
    best = F.min(F.struct("edits", "end_word", "similarity")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.edits", "b.similarity", "b.end_word")


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item (rows with a null doc_id stay)."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
