"""Quality classifier: Naive Bayes support vectors.

Hashed n-gram indicators (words; one to three word shapes) are scaled by the log ratio of their counts in the two
classes, each document to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.  Its margin
becomes a probability by a logistic curve fitted on documents that a first model has not seen.

The model is fitted on the driver from at most `MOST` labelled rows (a bound, not a share: 10,000 rows of some thousand
buckets are about 50 MB; what the fit took beside them is given back); scoring reads every whole text once, without a shuffle.

Cases: a null or empty text has no features and gets the score of the bias alone; a label that is null teaches nothing;
a null id is never held out and is scored; rows that repeat an id are scored each; other columns are ignored, or kept
by `keep_good`; without labels of both classes every score is the share of the class that there is, or 1 without any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _features, _labelled as L
from ._spark import give_back, table

MOST, BITS, CUT = 10_000, 18, 0.7


def descend(idx: np.ndarray, ptr: np.ndarray, scale: np.ndarray, norm: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss of unit rows scale[idx] / norm, with a bias feature of 1."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    rows = [(idx[ptr[i] : ptr[i + 1]], scale[idx[ptr[i] : ptr[i + 1]]] / norm[i]) for i in range(len(y))]
    square = np.array([1 + v @ v for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            grad = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[at] += step * v
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < close:
            break
    return w, bias


class Model:
    """Weights by bucket, bias, and the logistic curve over the margin."""

    def __init__(self, bits: int = BITS):
        self.scale = self.weight = np.zeros(1 << bits, np.float32)
        self.bias, self.slope, self.shift = 0.0, 0.0, 30.0

    def _fit(self, rows: list[np.ndarray], y: np.ndarray, cost: float, alpha: float) -> None:
        idx, ptr = L.flat(rows)
        n = len(self.scale)
        doc = np.repeat(np.arange(len(y)), np.diff(ptr))
        p, q = (alpha + np.bincount(idx[y[doc] == k], minlength=n) for k in (1, -1))
        self.scale = np.log((p / p.sum()) / (q / q.sum()))
        self.scale[(p + q) < 2 * alpha + 2] = 0  # seen in one document: says nothing about others
        norm = np.sqrt(L_sum(self.scale[idx] ** 2, ptr)) + 1e-9
        share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        w, self.bias = descend(idx, ptr, self.scale, norm, y, cost * np.sqrt(share))
        self.weight = w * self.scale

    def margin(self, idx: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return L_sum(self.weight[idx], ptr) / (np.sqrt(L_sum(self.scale[idx].astype(float) ** 2, ptr)) + 1e-9) + self.bias

    def fit(self, rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, alpha: float = 1.0) -> Model:
        y = np.where(label == 1, 1, -1)
        if len(y) == 0 or abs(y.sum()) == len(y):
            self.shift = 30.0 if len(y) == 0 or y[0] > 0 else -30.0
            return self
        kept = np.arange(len(y)) % 5 == 0
        both = lambda part: len({*y[part]}) == 2
        if both(kept) and both(~kept):
            self._fit([r for r, k in zip(rows, kept) if not k], y[~kept], cost, alpha)
            m, t = self.margin(*L.flat([r for r, k in zip(rows, kept) if k])), (y[kept] > 0).astype(float)
            self.slope, self.shift = logistic(m, t)
        else:
            self.slope, self.shift = 2.0, 0.0
        self._fit(rows, y, cost, alpha)
        self.scale, self.weight = self.scale.astype(np.float32), self.weight.astype(np.float32)
        return self

    def score(self, idx: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return L.sigmoid(self.slope * self.margin(idx, ptr) + self.shift)


def L_sum(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return _features.by_doc(values, ptr)


def logistic(m: np.ndarray, t: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of t over m, by Newton's method with a small ridge and smoothed targets."""
    pos, neg = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, b = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = L.sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.linalg.solve(h, x.T @ (p - t) + 1e-3 * b)
    return float(max(b[0], 0.05)), float(b[1])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, bits: int = BITS) -> Model:
    """A model from at most `most` rows of labels (doc_id, label) that are not null."""
    chosen = L.sample(labels.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("int").alias("label")), most)
    got = L.gather(docs.select("doc_id", "text"), chosen, _features.style, bits)
    model = Model(bits).fit([x for _, _, x in got], np.array([y for _, y, _ in got], int))
    del got
    give_back()
    return model


def scores(docs: DataFrame, labels: DataFrame, most: int = MOST, cut: float = CUT) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted; labels: doc_id, quality."""
    held = L.held_out("doc_id", 4, 2)
    model = train(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")), most)
    return L.scored(docs, _features.style, BITS, model.score, cut, held)


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least `cut`, all their columns, without a shuffle."""
    from collections.abc import Iterator

    import pyarrow as pa

    from . import _text as X
    from ._spark import tune

    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, out = b.column(at).fill_null(""), [np.zeros(0, bool)]
            for lo, hi in X.slices(col):
                out.append(model.score(*_features.style(col.slice(lo, hi - lo), BITS)) >= cut)
            yield b.filter(pa.array(np.concatenate(out)))

    return docs.mapInArrow(rows, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES, SQL = {"op2_quality": op2_quality}, {}
