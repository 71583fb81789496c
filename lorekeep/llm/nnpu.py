"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are used as examples, against unlabelled text of the corpus. With the class
prior p, the risk of a scorer f is p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): the second part estimates the
risk on clean text and can't be negative, so where a batch drives it under zero the step goes back up
instead. The scorer is linear on n-gram indicators with logistic loss, trained by Adam in numpy on bounded samples; which
indicators it may use is told by counts over the whole corpus.
The class prior is a parameter. Without one it is the toxic share of all usable labels, for which alone labels of clean
documents are counted; they are never examples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .features import NGrams, Rows, bucket_counts, corpus_counts, labelled_sample, one_per_id, sigmoid, sparse_rows
from .nbsvm import scored

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
NGRAMS = NGrams(word="alnum", lower=True, orders=(1,), bits=18, chars=(5,))
EPOCHS = 30
BATCH = 512
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3
#: An indicator is used if its share among positives exceeds the unlabelled share by so many standard errors.
MIN_Z = 5.0
MIN_SEEN = 3


@dataclass
class Model:
    ngrams: NGrams
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, bucket = self.ngrams.of(texts)
        return sigmoid(np.bincount(doc, self.weight[bucket], len(texts)) + self.bias)


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The buckets whose share among positives exceeds the unlabelled one beyond chance."""
    share = (in_p + in_u) / max(1, n_p + n_u)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    return np.flatnonzero(((in_p / max(1, n_p) - in_u / max(1, n_u)) / spread > MIN_Z) & (in_p >= MIN_SEEN))


def fit(positive: Rows, unlabelled: Rows, prior: float, used: np.ndarray, ngrams: NGrams = NGRAMS) -> Model:
    """used: the buckets that rows may hold. Without positives (or unlabelled rows) the model scores the prior throughout."""
    size = 1 << ngrams.bits
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    if not len(positive.y) or not len(unlabelled.y):
        return Model(ngrams, np.zeros(size), bias)
    w = np.zeros(len(used) + 1)
    w[-1] = bias
    rows = [(np.searchsorted(used, part.bucket), part.offset) for part in (positive, unlabelled)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(0)
    steps = max(1, len(unlabelled.y) // BATCH)
    per_step = max(1, min(BATCH // 2, len(positive.y)))
    t = 0

    def batch(which: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket, offset = rows[which]
        sizes = offset[ids + 1] - offset[ids]
        at = np.repeat(offset[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        doc = np.repeat(np.arange(len(ids)), sizes)
        return doc, bucket[at], np.bincount(doc, w[bucket[at]], len(ids)) + w[-1]

    for _ in range(EPOCHS):
        order = rng.permutation(len(unlabelled.y))
        for k in range(steps):
            u = batch(1, order[k * len(order) // steps : (k + 1) * len(order) // steps])
            p = batch(0, rng.integers(0, len(positive.y), per_step))
            clean = np.logaddexp(0, u[2]).mean() - prior * np.logaddexp(0, p[2]).mean()
            # derivatives of the risks in f
            up = sigmoid(u[2]) / len(u[2])
            down = -prior * sigmoid(p[2]) / len(p[2])
            toxic = -prior * sigmoid(-p[2]) / len(p[2])
            gu, gp = (up, toxic + down) if clean >= 0 else (-up, -down)
            grad = np.bincount(u[1], gu[u[0]], len(w)) + np.bincount(p[1], gp[p[0]], len(w))
            grad[-1] = gu.sum() + gp.sum()
            grad[:-1] += DECAY * w[:-1]
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(size)
    full[used] = w[:-1]
    return Model(ngrams, full, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """usable: of doc_id; which labels and which unlabelled texts may be learnt from. prior: the toxic share of the corpus (None: that of the usable labels).

    Indicators are screened by their counts over the texts of all rows, usable or not (no label is read there), against those over at most
    max_positive usable toxic ids. The gradient steps take samples picked by the hash of the id: the smallest hashes of toxic ids, and of
    the usable corpus all ids under a hash limit that gives about max_unlabelled. Null labels and null ids are left out; of repeated ids
    one row is used; a null text is an empty one, and long texts are read in slices. Without toxic examples, or without texts, every score is the
    prior. Only doc_id, text and toxic are read, whatever else the tables have."""
    toxic = labels.where(F.col("toxic") == 1)
    in_u, rows = corpus_counts(docs, NGRAMS)
    corpus = docs.where(usable).count()
    positive = labelled_sample(docs, toxic, "toxic", usable, max_positive)
    part = min(1.0, max_unlabelled / max(1, corpus))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))
    unlabelled = one_per_id(docs.where(usable & spread & F.col("doc_id").isNotNull()).select("doc_id", F.lit(0).alias("y"), "text"))
    # first the counts of all indicators, then the rows with the telling ones: the driver gets little of either
    in_p = bucket_counts(sparse_rows(positive, NGRAMS, "y"), 1 << NGRAMS.bits)[1]
    used = telling(in_p, in_u, positive.count(), rows)
    p, u = (Rows.collect(sparse_rows(x, NGRAMS, "doc_id", "y", only=used)) for x in (positive, unlabelled))
    return fit(p, u, (labels.where(usable).agg(F.avg("toxic")).first()[0] or 0.0) if prior is None else prior, used)


def op2_nn_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out quarter are never read. A null or empty text
    gets the score of no indicators; repeated rows are scored each; an empty table gives an empty table."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return scored(docs.select("doc_id", "text"), model, THRESHOLD).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
