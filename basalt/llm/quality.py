"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics.  A class has a Gaussian whose covariance is shrunk
towards the pooled one (lam) and towards a multiple of the identity (gam); the score is the logistic of
the difference of the two log densities, from Mahalanobis distances with Cholesky factors that are
computed once, scaled by a temperature and bias fitted on rows left out of the inner fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .words import LETTER, SPACE, Words, pieces, runs

#: Labelled rows that the model is fitted on at most, chosen by the hash of their id.
SAMPLE = 20_000

STATS = ("log_chars", "log_words", "word_length", "word_spread", "upper", "digit", "space", "bang", "pipe", "symbol", "other_punct", "beyond_ascii", "distinct", "top_word", "next_same", "distinct3", "stop_ends", "short_words", "log_line", "cased_words")


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[np.frombuffer(chars, np.uint8)] = True
    return m


_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_CLASSES = {
    "upper": _UPPER, "digit": _DIGIT, "space": SPACE, "bang": _mask(b"!?"), "pipe": _mask(b"|<>[]{}\\/_=+~^"), "symbol": _mask(b"#$%&*@"),
    "other_punct": _mask(b".,;:'\"()-`"), "beyond_ascii": np.arange(256) >= 128, "line": _mask(b"\n"), "letter": LETTER,
}


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text: logarithms of sizes, arcsine roots of shares."""
    out = np.zeros((len(column), len(STATS)))
    for a, b, data, offs in pieces(column):
        n, size = b - a, np.diff(offs).astype(float)
        w = Words(data, offs)
        length = w.end - w.start
        words = w.count.astype(float)
        some, per_word = np.maximum(size, 1), np.maximum(words, 1)
        sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])[offs])  # noqa: E731, B023
        by_doc = lambda x: np.bincount(w.doc, x, minlength=n)  # noqa: E731, B023
        share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
        c = {k: sums(m) for k, m in _CLASSES.items()}
        mean = by_doc(length) / per_word
        distinct, top = runs(w.doc, w.hash, n)
        d3, h3 = w.shingles(3)
        three = np.bincount(d3, minlength=n)
        distinct3, _ = runs(d3, h3, n)
        same = np.zeros(len(w.hash))
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        last, first = (data[w.end - 1], data[w.start]) if len(length) else (data[:0], data[:0])
        out[a:b] = np.column_stack([
            np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(by_doc(length.astype(float) ** 2) / per_word - mean**2, 0))),
            share(c["upper"], np.maximum(c["letter"], 1)), *(share(c[k], some) for k in ("digit", "space", "bang", "pipe", "symbol", "other_punct", "beyond_ascii")),
            np.log1p(distinct) / np.log1p(per_word), share(top, per_word), share(by_doc(same), per_word), share(distinct3, np.maximum(three, 1)),
            share(by_doc(_CLASSES["other_punct"][last]), per_word), share(by_doc(length <= 3), per_word), np.log1p(size / (c["line"] + 1)), share(by_doc(_UPPER[first]), per_word),
        ])
    return out


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the shrunk covariance
    constant: float  # log prior - log determinant / 2

    def __post_init__(self):
        self.whiten = np.tril(np.linalg.inv(self.factor))  # once, so that a batch costs one product

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = self.whiten @ (x - self.mean).T
        return self.constant - 0.5 * (z * z).sum(0)


@dataclass
class QuadraticModel:
    """score = logistic(slope * (log density of class 1 - of class 0) + bias); one class alone gives its prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None
    slope: float = 1.0
    bias: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -20, 20)
        return self.classes[1].log_density(z) - self.classes[0].log_density(z)

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.slope * self.difference(x) + self.bias if self.classes else np.full(len(x), self.bias)
        return 1 / (1 + np.exp(-np.clip(d, -30, 30)))


def _gaussians(z: np.ndarray, y: np.ndarray, lam: float, gam: float) -> tuple[Gaussian, Gaussian]:
    own = [z[y == k] for k in (0, 1)]
    mean = [o.mean(0) for o in own]
    cov = [(o - m).T @ (o - m) / max(len(o) - 1, 1) for o, m in zip(own, mean)]
    pooled = sum(c * len(o) for c, o in zip(cov, own)) / len(z)
    out = []
    for o, m, c in zip(own, mean, cov):
        c = (1 - lam) * c + lam * pooled
        c = (1 - gam) * c + gam * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        f = np.linalg.cholesky(c + 1e-9 * np.eye(len(c)))
        out.append(Gaussian(m, f, np.log(len(o) / len(z)) - np.log(np.diag(f)).sum()))
    return tuple(out)


def _platt(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve over d, by damped Newton steps with a small ridge."""
    s = max(np.abs(d).mean(), 1e-9)
    x = np.column_stack([np.clip(d / s, -5, 5), np.ones(len(d))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.5 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(w[0], 1e-3) / s, w[1]


def fit(x: np.ndarray, y: np.ndarray) -> QuadraticModel:
    """lam and gam are chosen by log loss on every fourth row, which also fits slope and bias."""
    n1 = int(y.sum())
    centre = np.median(x, 0) if len(x) else np.zeros(len(STATS))
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(len(STATS))
    if min(n1, len(y) - n1) < 8:
        return QuadraticModel(centre, scale, None, bias=float(np.log((n1 + 1) / (len(y) - n1 + 1))))
    z = np.clip((x - centre) / scale, -20, 20)
    left = np.zeros(len(y), bool)
    for k in (0, 1):  # every fourth row of each class
        left[np.flatnonzero(y == k)[::4]] = True
    best = None
    for lam in (0.05, 0.2, 0.5):
        for gam in (0.01, 0.05, 0.2):
            a, b = _gaussians(z[~left], y[~left], lam, gam)
            d = b.log_density(z[left]) - a.log_density(z[left])
            slope, bias = _platt(d, y[left])
            p = 1 / (1 + np.exp(-np.clip(slope * d + bias, -30, 30)))
            loss = -np.mean(np.where(y[left] == 1, np.log(p), np.log(1 - p)))
            if best is None or loss < best[0] - 1e-6:
                best = (loss, lam, gam, slope, bias)
    _, lam, gam, slope, bias = best
    return QuadraticModel(centre, scale, _gaussians(z, y, lam, gam), slope, bias)


def held_out(doc_id: str = "doc_id"):
    """Rows whose label is never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) for at most `sample` labelled rows that are not held out, smallest id hash first.

    Rows with null ids or labels, and ids whose labels disagree, are left out.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__m")).where("y = __m").drop("__m")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded table, so broadcast
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QuadraticModel:
    """Fit on the driver, from `sample` vectors of 20 numbers at most; of rows that share a doc_id, the smallest vector counts."""
    rows = training_rows(docs, labels, label, sample)
    schema = "doc_id bigint, y int, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = sorted((r.doc_id, r.y, r.x) for r in rows.select("doc_id", "text", "y").mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*").collect())
    x = np.array([r[2] for r in got]).reshape(-1, len(STATS))
    return fit(x, np.array([r[1] for r in got], int))


def score_documents(docs: DataFrame, model: QuadraticModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Every column of docs with `score` (double, 0 to 1) and `predicted` (int, 1 if score >= 0.5).

    Null text scores as empty text, which gets a score like any other; columns so named are replaced.
    No shuffle: each partition is scored with the broadcast model of fixed size.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (score, predicted)]
    at = keep.index(text)
    schema = docs.select(*keep).schema.add(score, "double").add(predicted, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score(statistics(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, score, predicted])

    return docs.select(*keep).mapInArrow(run, schema)
