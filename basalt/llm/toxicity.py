"""Toxicity by cumulative-link ordinal regression over sparse features: words and word beginnings.

P(grade <= k | x) = logistic(theta_k - w.x): one weight vector is shared by all thresholds
theta_0 < theta_1 < ...  The output is the expected grade.  Labels may hold any number of ordered
grades; a two-valued label is graded 0, 1, 2, 3 by how many cue words a toxic training text uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .quality import SAMPLE, held_out, training_rows
from .words import LETTER, Words, mix, pieces

__all__ = ["OrdinalModel", "held_out", "score_documents", "train"]

#: Words that the model may weigh, by how unevenly the grades use them.
FEATURES = 512
#: Lengths in bytes of the word beginnings that count as features beside whole words: stems survive inflection.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Training texts that must use a word before it can become a feature.
LEAST = 5
#: Uses of cue words from which a toxic text has grade 1, 2, 3, when labels hold only 0 and 1.
STEPS = (0, 2, 4)


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word (a run of letters, A-Z lowered) and of its beginnings of 3 to 7 bytes."""
    w = Words(data, offs, LETTER)
    docs, hashes = [w.doc], [w.hash]
    for k, (which, h) in w.beginnings(BEGINNINGS).items():
        docs.append(w.doc[which])
        hashes.append(mix(h + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(hashes)


def word_uses(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, uses) of the words and word beginnings in a sorted array of hashes."""
    rows, feats, uses = [], [], []
    likely = np.zeros(1 << 16, bool)
    likely[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    for a, _, data, offs in pieces(column) if len(vocabulary) else ():
        doc, h = units(data, offs)
        maybe = np.flatnonzero(likely[(h >> np.uint64(48)).astype(np.int64)])
        doc, h = doc[maybe], h[maybe]
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        ok = np.flatnonzero(vocabulary[at] == h)
        key, n = np.unique(doc[ok] * len(vocabulary) + at[ok], return_counts=True)
        rows.append(key // len(vocabulary) + a)
        feats.append(key % len(vocabulary))
        uses.append(n)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(uses)


def _dense(column: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """1 + log(uses) of each feature that a text has, for one batch of texts at a time."""
    out = np.zeros((len(column), max(len(vocabulary), 1)), np.float32)
    r, f, n = word_uses(column, vocabulary)
    out[r, f] = 1 + np.log(n)
    return out


@dataclass
class OrdinalModel:
    vocabulary: np.ndarray  # sorted word hashes
    weights: np.ndarray
    theta: np.ndarray  # ascending thresholds, one fewer than grades

    def margin(self, column: pa.Array) -> np.ndarray:
        r, f, n = word_uses(column, self.vocabulary)
        return np.bincount(r, self.weights[f] * (1 + np.log(n)) if len(r) else None, minlength=len(column))[: len(column)].astype(float)

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - margin[:, None], -30, 30)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by Adam on the whole sample."""
    n, d = x.shape
    share = np.clip([(y > k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(grades - 1))
    # thresholds are the first one and positive gaps, so that they stay in order
    params = np.concatenate([np.zeros(d), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = params[:d], np.exp(params[d + 1 :])
        theta = params[d] + np.concatenate([[0], np.cumsum(gaps)])
        cum = np.ones((n, grades + 1))
        cum[:, 0] = 0
        cum[:, 1:-1] = 1 / (1 + np.exp(-np.clip(theta[None, :] - (x @ w)[:, None], -30, 30)))
        p = np.maximum(cum[rows, y + 1] - cum[rows, y], 1e-12)
        slope = cum * (1 - cum)
        hi, lo = slope[rows, y + 1] / p, slope[rows, y] / p
        g_w = x.T @ (hi - lo) / n + l2 * w  # of the negative log likelihood
        g_theta = np.array([(lo[y == k + 1].sum() - hi[y == k].sum()) / n for k in range(grades - 1)])
        g_gap = np.array([g_theta[k + 1 :].sum() * gaps[k] for k in range(grades - 2)])
        g = np.concatenate([g_w, [g_theta.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> OrdinalModel:
    """Fit on at most `sample` labelled rows that are not held out; the driver gets `features` numbers a row at most.

    Of rows that share a doc_id, the smallest text counts.  Of the words that grades use unevenly (a standard
    score of 4 or more), the `features` most uneven ones become features; raise it where more are wanted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = training_rows(docs, labels, label, sample).groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*")
    rows = scratch.put(rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, hs = [], []
            for a, _, data, offs in pieces(b.column(0)):
                doc, h = units(data, offs)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                y = np.asarray(b.column(1).to_numpy(zero_copy_only=False))
                ys.append(y[doc[new] + a])
                hs.append(h[new].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ys), pa.int32()), pa.array(np.concatenate(hs), pa.int64())], names=["y", "h"])

    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = sum(n for y, n in sizes.items() if y > 0), sizes.get(0, 0)
    grades = max([1, *sizes]) + 1
    if not pos or not neg:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, np.log((neg + 1) / (pos + 1))))
    used = rows.select("text", "y").mapInArrow(words, "y int, h bigint").groupBy("h").agg(F.sum((F.col("y") > 0).cast("int")).alias("p"), F.count("*").alias("n"))
    lift = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    # how far the uneven use of a word is from chance, as a standard score
    z = lift / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    best = used.where(F.col("n") >= LEAST).select("h", z.alias("z")).orderBy(F.abs("z").desc(), "h").limit(features).collect()
    best = [(np.uint64(r.h % 2**64), r.z) for r in best if abs(r.z) >= 4]
    vocabulary = np.sort(np.array([h for h, _ in best], np.uint64))
    cues = np.isin(vocabulary, np.array([h for h, z in best if z > 0], np.uint64))
    if not len(vocabulary):
        return OrdinalModel(vocabulary, np.zeros(0), np.full(grades - 1, np.log((neg + 1) / (pos + 1))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _dense(b.column(0), vocabulary)
            ix = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([i.tolist() for i in ix], pa.list_(pa.int32())), pa.array([r[i].tolist() for r, i in zip(x, ix)], pa.list_(pa.float32()))], names=["y", "i", "v"])

    got = rows.orderBy("doc_id").select("text", "y").mapInArrow(vectors, "y int, i array<int>, v array<float>").collect()
    scratch.drop(rows)
    got.sort(key=lambda r: (r.y, r.i, r.v))  # sums in one order give one model
    x = np.zeros((len(got), len(vocabulary)))
    for k, r in enumerate(got):
        x[k, r.i] = r.v
    y = np.array([r.y for r in got])
    if grades == 2:
        uses = np.rint(np.where(x[:, cues] > 0, np.exp(x[:, cues] - 1), 0)).sum(1)
        y = np.where(y > 0, np.searchsorted(STEPS, uses, side="right").clip(1), 0)
        grades = len(STEPS) + 1
    w, theta = fit_ordinal(x, y, grades)
    return OrdinalModel(vocabulary, w, theta)


def score_documents(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """Columns of docs with severity (expected grade), p_toxic (P(grade > 0)) and toxic_predicted (p_toxic >= 0.5).

    Null or empty text has no features and gets the grade of the thresholds alone.  Columns so named
    are replaced.  No shuffle; the broadcast model has at most FEATURES words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("severity", "p_toxic", "toxic_predicted")]
    at = keep.index(text)
    schema = docs.select(*keep).schema.add("severity", "double").add("p_toxic", "double").add("toxic_predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = shared.value.above(shared.value.margin(b.column(at)))
            p = above[:, 0]
            cols = [pa.array(above.sum(1)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "severity", "p_toxic", "toxic_predicted"])

    return docs.select(*keep).mapInArrow(run, schema)
