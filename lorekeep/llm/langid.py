"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Counts of hashed character 1- to 3-grams of the lower-cased text are weighted by log(1 + tf) * idf and brought
to length 1. Document frequencies are counted over all documents that may be learnt from, in one pass
that adds up per-partition vectors of 2**BITS counts. Weights come from follow-the-regularised-leader with
elastic-net penalties (per coordinate; the L1 part leaves most at zero) over at most about ``MAX_ROWS`` rows, and
a temperature fitted on rows kept out of the training calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, steps, table
from .tokens import mix

BITS = 15
ORDERS = (1, 2, 3)
MAX_ROWS = 8_000
#: Rows of a language that are learnt from at least (all, if it has fewer).
MIN_CLASS_ROWS = 200
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 1e-3
CALIBRATION_PART = 5
UNKNOWN = "und"
#: Characters of a text that are held as n-grams at once.
SLICE = 1 << 18


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text, in slices that overlap by the longest order less one."""
    lowered = text.lower()
    points = np.frombuffer(f" {lowered} ".encode("utf-32-le"), np.uint32)
    out = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(points), SLICE):
        for n in ORDERS:
            part = points[start : start + SLICE + n - 1].astype(np.uint64)
            size = len(part) - n + 1
            if size > 0:
                code = part[:size].copy()
                for j in range(1, n):  # a code point has 21 bits: three fit
                    code = (code << np.uint64(21)) | part[j : j + size]
                out += np.bincount((mix(code + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=len(out))
    return out


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.log1p(counts) * idf[at]
    length = np.sqrt(x @ x)
    return at, x / length if length else x


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    return weighted(at, counts[at], idf)


def counted(sample: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of a bounded sample's texts that have a letter, in an order that does not depend on partitions. Counting is done
    in the tasks: the driver gets at most 2**BITS numbers of a text, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                found = [(i, lang, np.flatnonzero(c), c) for i, lang, t in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), texts, strict=True) if has_letter(t.decode()) for c in (gram_counts(t.decode()),)]
                lists = [pa.array([x[2] for x in found], pa.list_(pa.int32())), pa.array([x[3][x[2]] for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([str(x[0]) for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), *lists], names=["id", "lang", "at", "n"])

    rows = sample.select("doc_id", "lang", "text").mapInArrow(run, "id string, lang string, at array<int>, n array<int>").toArrow()
    ids, langs, at, n = (rows.column(c) for c in ("id", "lang", "at", "n"))
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(ids[i].as_py().encode()), ids[i].as_py(), langs[i].as_py()))
    return [(langs[i].as_py(), at[i].values.to_numpy(), n[i].values.to_numpy()) for i in order]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weight: np.ndarray  # buckets by classes; the last row is the bias
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = tf_idf(text, self.idf)
        return x @ self.weight[at] + self.weight[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights, with the closed-form elastic-net solution at each touched coordinate."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at, x = np.append(rows[i][0], 1 << BITS), np.append(rows[i][1], 1.0)
            zs, ns = z[at], n[at]
            w = solve(zs, ns)
            p = softmax(x @ w)
            p[y[i]] -= 1.0
            g = np.outer(x, p)
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    return solve(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, g = np.log(0.05), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, over all rows of ``docs``: a task adds up its own counts, and the driver
    gets 2**BITS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, texts in steps(batch, "text"):
                for t in texts:
                    if t:
                        df += gram_counts(t.decode()) > 0
                        rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out, rows = np.zeros(1 << BITS, np.int64), 0
    for bucket, n in zip(got.column("bucket").to_pylist(), got.column("n").to_pylist(), strict=True):
        if bucket < 0:
            rows = n
        else:
            out[bucket] = n
    return out, rows


def train(docs: DataFrame, usable: Column, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text, lang. Learns from rows for which ``usable`` holds; null languages and texts without
    letters are left out, as are other columns. The training sample is all rows whose id hashes under the limit that gives max_rows, and
    for a rare language MIN_CLASS_ROWS; of rows that repeat an id and a language one is used. Without two languages nothing is learnt: every text
    is then of the only one, or ``und``."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, rows = document_frequencies(known)
    idf = np.log((1 + rows) / (1 + df)) + 1.0
    # a row per language: as many as there are languages
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, max(max_rows / max(1, rows), MIN_CLASS_ROWS / n)) for c, n in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for c, p in share.items() for x in (c, int(p * (1 << 40)))]), F.col("lang")) if share else F.lit(0)
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) < limit)
    got = counted(picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")))
    classes = sorted({r[0] for r in got})
    y = np.array([classes.index(r[0]) for r in got], np.int64)
    features = [weighted(at, n, idf) for _, at, n in got]
    held = np.arange(len(got)) % CALIBRATION_PART == 0
    model = Model(classes, idf, np.zeros(((1 << BITS) + 1, max(1, len(classes)))))
    if len(classes) > 1:
        fitted = ftrl([f for f, h in zip(features, held, strict=True) if not h], y[~held], len(classes))
        logits = np.array([features[i][1] @ fitted[features[i][0]] + fitted[-1] for i in np.flatnonzero(held)])
        model.weight, model.temperature = fitted, temperature(logits, y[held])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (replaced if there). A null text, or one without a letter, is ``und`` with
    score 0; so is every text if nothing could be learnt."""
    base = docs.drop("lang_pred", "score")
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                found = [held.value.predict(t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def op3_ftrl_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; languages of the held-out fifth are never read. Ties go to the first
    language by code point; repeated rows are predicted each; an empty table gives an empty table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold(F.col("doc_id"), 5) != 0)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
