"""Toxicity: non-negative positive-unlabelled learning with numpy.

Confirmed toxic examples and unlabelled texts (any documents, whatever their labels) train a linear classifier over
hashed indicators of words and of their first 5 to 10 bytes.  The risk of the negative class is that of the unlabelled texts less the class
prior times that of the positives; where it falls below zero in a batch, the step goes up its gradient instead, so
that the model does not explain the positives away.  The class prior is the positives' share of the labelled rows.

At most `POSITIVE` positives and `UNLABELLED` other texts train the model on the driver; scoring reads every whole text
once, without a shuffle.

Cases: a null or empty text has no features and gets the score of the bias alone; null labels teach nothing; a null id
is never held out and is scored; rows that repeat an id are scored each; other columns are ignored; without a positive
every score is 0.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _features, _labelled as L
from ._spark import table

POSITIVE, UNLABELLED, BITS, CUT = 4_000, 8_000, 18, 0.5
#: Steps with either loss, of a batch of some 400 unlabelled texts each, whatever the number of texts.
STEPS = 1_200


class Model:
    def __init__(self, bits: int = BITS):
        self.weight, self.bias = np.zeros(1 << bits), -30.0

    def margin(self, idx: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return _features.by_doc(self.weight[idx], ptr) + self.bias

    score = lambda self, idx, ptr: L.sigmoid(self.margin(idx, ptr))

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = 0.1, ridge: float = 3e-5, least: float = 6.0, seed: int = 7) -> Model:
        """Adam on the non-negative risk, `steps` with the logistic loss, and as many with the sigmoid loss from there.

        Only buckets that differ between positive and unlabelled texts by at least `least` standard errors, and are in
        five texts or more, get a weight: a bucket that is as usual in both says nothing.
        """
        if not positive or not unlabelled:
            return self
        n = len(self.weight)
        in_p, in_u = (np.bincount(np.concatenate(rows), minlength=n) for rows in (positive, unlabelled))
        share = (in_p + in_u) / (len(positive) + len(unlabelled))
        error = np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
        used = (np.abs(in_p / len(positive) - in_u / len(unlabelled)) >= least * error) & (in_p + in_u >= 5)
        to = np.cumsum(used) - 1
        positive, unlabelled = ([to[r[used[r]]] for r in rows] for rows in (positive, unlabelled))
        dims = int(used.sum())
        w, b = np.zeros(dims), float(np.log(prior / (1 - prior)))
        m, v, mb, vb, t = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 0
        rng, parts = np.random.default_rng(seed), max(1, len(unlabelled) // 400)
        while t < 2 * steps:
            order = zip(np.array_split(rng.permutation(len(positive)), parts), np.array_split(rng.permutation(len(unlabelled)), parts))
            for some_p, some_u in order:
                if t == 2 * steps:
                    break
                bounded = t >= steps
                if not len(some_p):
                    some_p = rng.integers(0, len(positive), 1)
                idx, ptr = L.flat([positive[i] for i in some_p] + [unlabelled[i] for i in some_u])
                f = _features.by_doc(w[idx], ptr) + b
                p = np.arange(len(f)) < len(some_p)
                s, each = L.sigmoid(f), np.where(p, prior / len(some_p), 1 / len(some_u))
                # losses as a negative and as a positive, and their slopes
                as_negative = s if bounded else np.logaddexp(0, f)
                up, down = (s * (1 - s),) * 2 if bounded else (s, 1 - s)
                negative = (each * as_negative)[~p].sum() - (each * as_negative)[p].sum()
                d = np.where(p, -each, each) * up  # of the risk as negatives
                d = -d if negative < 0 else d - np.where(p, each, 0) * down
                g = np.bincount(idx, weights=np.repeat(d, np.diff(ptr)), minlength=dims) + ridge * w
                gb, t = d.sum(), t + 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                a, c = 1 - 0.9**t, 1 - 0.999**t
                w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
                b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
        self.weight[used], self.bias = w, float(b)
        return self


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, bits: int = BITS) -> Model:
    """labels: (doc_id, label) that may be learnt from; prior: by default the share of label 1."""
    known = labels.where("doc_id is not null and label is not null")
    if prior is None:
        prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    positive = L.sample(known.where("label = 1").select("doc_id", F.lit(1).alias("label")), POSITIVE)
    unlabelled = L.sample(docs.where("doc_id is not null").select("doc_id").withColumn("label", F.lit(0)), UNLABELLED)
    got = L.gather(docs.select("doc_id", "text"), positive.unionByName(unlabelled), _features.bare, bits)
    return Model(bits).fit([x for _, y, x in got if y], [x for _, y, x in got if not y], min(max(prior or 0, 1e-4), 0.9))


def scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted; labels: doc_id, toxic."""
    held = L.held_out("doc_id", 5, 0)
    model = train(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")))
    return L.scored(docs, partial(_features.bare, used=model.weight != 0), BITS, model.score, cut, held)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES, SQL = {"op5_toxicity": op5_toxicity}, {}
