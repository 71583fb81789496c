"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the classes' log-count ratio, rows are brought to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent on at most ``MAX_ROWS`` labelled documents. Margins of a
fifth of those rows, kept out of the fit, give Platt's sigmoid. Every whole text is then scored in one
pass with the broadcast weights (2**bits numbers, whatever the corpus).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, steps, table
from .features import NGrams, Rows, labelled_sample, platt, sigmoid, sparse_rows

MAX_ROWS = 10_000
NGRAMS = NGrams(word="runs", lower=False, orders=(1, 2), bits=18, repeats=True)
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 10
CALIBRATION_PART = 5


@dataclass
class Model:
    ngrams: NGrams
    ratio: np.ndarray  # log-count ratio by bucket
    weight: np.ndarray  # ratio times the fitted weight
    bias: float
    a: float
    b: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        return self.margins_of(*self.ngrams.of(texts), len(texts))

    def margins_of(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(doc, np.square(self.ratio)[bucket], n))
        return np.bincount(doc, self.weight[bucket], n) / np.maximum(length, 1e-9) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.a * self.margins(texts) + self.b)


def dual_descent(rows: Rows, scale: np.ndarray, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss; cost: the upper bound of each row's dual variable."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows.y))
    sign = np.where(rows.y > 0, 1.0, -1.0)
    scale = scale.astype(np.float32)
    values = scale[rows.bucket]
    length = np.zeros(len(rows.y))
    parts = []
    for i, (a, b) in enumerate(zip(rows.offset[:-1].tolist(), rows.offset[1:].tolist(), strict=True)):
        x = values[a:b]
        length[i] = np.sqrt(float(x @ x))
        x /= max(length[i], 1e-9)
        parts.append((rows.bucket[a:b], x))
    square = np.where(length > 0, 1.0, 0.0) + 1.0
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(parts)).tolist():
            at, x = parts[i]
            gradient = sign[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * sign[i] * x
                bias += step * sign[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit(rows: Rows, ngrams: NGrams = NGRAMS) -> Model:
    """The model of bounded training rows. Of one class only (or no rows) it scores that class's share throughout."""
    size = 1 << ngrams.bits
    if len(set(rows.y.tolist())) < 2:
        share = (rows.y.sum() + 1) / (len(rows.y) + 2)
        return Model(ngrams, np.zeros(size), np.zeros(size), float(np.log(share / (1 - share))), 1.0, 0.0)

    def trained(part: Rows) -> Model:
        neg, pos = part.counts(size) + SMOOTHING
        ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
        share = np.array([(part.y <= 0).mean(), (part.y > 0).mean()])
        w, bias = dual_descent(part, ratio, COST * 0.5 / np.maximum(share, 1e-3)[(part.y > 0).astype(int)], EPOCHS)
        return Model(ngrams, ratio, ratio * w, bias, 1.0, 0.0)

    kept_out = np.arange(len(rows.y)) % CALIBRATION_PART == 0
    held = rows.take(np.flatnonzero(kept_out))
    if len(set(rows.y[~kept_out].tolist())) == 2:
        first = trained(rows.take(np.flatnonzero(~kept_out)))
        margin = [first.margins_of(np.zeros(len(held.row(i)), np.int64), held.row(i), 1)[0] for i in range(len(held.y))]
        a, b = platt(np.array(margin), held.y)
        del first
    else:
        a, b = 1.0, 0.0
    model = trained(rows)
    model.a, model.b = a, b
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable=None, max_rows: int = MAX_ROWS) -> Model:
    """Fits the classifier on at most ``max_rows`` labelled ids for which ``usable`` (of doc_id) holds. Null labels and ids are left out; of
    repeated ids one row is used; a null text is an empty one, and long texts are read in slices; without labels of both classes the
    share of one class is the score throughout. Only doc_id, text and the label are read, whatever else the tables have."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, max_rows)
    return fit(Rows.collect(sparse_rows(sample, NGRAMS, "doc_id", "y")))


def scored(docs: DataFrame, model, threshold: float, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and a predicted 0 or 1; columns of these names are replaced. A null or empty text
    has no n-grams and gets the score of the bias. model: anything with scores(texts)."""
    base = docs.drop(score, predicted)
    schema = base.withColumns({score: F.lit(0.0), predicted: F.lit(0)}).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                s = held.value.scores(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*part.schema.names, score, predicted])

    return base.mapInArrow(run, schema)


def op7_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out third are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, usable=fold(F.col("doc_id"), 3) != 1)
    return scored(docs.select("doc_id", "text"), model, 0.5).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
