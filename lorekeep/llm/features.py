"""Hashed n-gram indicators, bounded labelled samples and score calibration for the text classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps
from .tokens import SLICE_BYTES, Words, byte_grams, gram_hash, slices, words


#: Bands of the share of distinct n-grams, and indicators of each band.
BANDS = 20
COPIES = 8


@dataclass(frozen=True)
class NGrams:
    """Which n-grams become indicators: the word class and case (see tokens), the orders and 2**bits buckets.
    With ``repeats``, ``COPIES`` further indicators name the band of the share of n-grams that are distinct."""

    word: str = "runs"
    lower: bool = False
    orders: tuple[int, ...] = (1, 2)
    bits: int = 18
    repeats: bool = False
    chars: tuple[int, ...] = ()  # orders of byte n-grams

    def _keys(self, w: Words, held: int = 0) -> np.ndarray:
        """Text and bucket, as one number, of every n-gram that is not wholly within the first ``held`` words (or, of bytes, within
        what they span)."""
        keys = []
        for n in self.orders:
            at = np.arange(max(0, held - n + 1), max(0, len(w.hash) - n + 1))
            at = at[w.doc[at] == w.doc[at + n - 1]] if n > 1 else at
            bucket = gram_hash(w.hash, at, n) >> np.uint64(64 - self.bits)
            keys.append((w.doc[at].astype(np.int64) << self.bits) | bucket.astype(np.int64))
        for n in self.chars:
            doc, hashed = byte_grams(w, n)
            keys.append((doc.astype(np.int64) << self.bits) | (hashed >> np.uint64(64 - self.bits)).astype(np.int64))
        return np.concatenate(keys)

    def _of_long(self, text: bytes) -> tuple[np.ndarray, int]:
        """Distinct buckets of a long text and its number of n-grams, slice by slice."""
        seen, total = np.zeros(1 << self.bits, bool), 0
        for w, held in slices(text, self.word, self.lower, max([*self.orders, 2]) - 1):
            keys = self._keys(w, held)
            seen[keys] = True
            total += len(keys)
        return np.flatnonzero(seen), total

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every distinct indicator, in the order of texts. A text of over SLICE_BYTES, which is a step of its own, is
        read in slices, each with the last word of the one before it."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            both, n = self._of_long(texts[0])
            total = np.array([n])
        else:
            both = self._keys(words(texts, self.word, self.lower))
            both.sort()
            total = np.bincount(both >> self.bits, minlength=len(texts))
            both = _distinct(both)
        if self.repeats:
            share = np.bincount(both >> self.bits, minlength=len(texts)) / np.maximum(total, 1)
            band = np.where(total > 0, np.ceil(share * BANDS), 0).astype(np.int64)
            at = np.arange(len(texts))[:, None] << self.bits
            both = np.concatenate([both, (at | (band[:, None] * COPIES + np.arange(COPIES))).ravel()])
            both.sort()
            both = _distinct(both)
        return both >> self.bits, both & ((1 << self.bits) - 1)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return ordered[fresh]


def sparse_rows(docs: DataFrame, ngrams: NGrams, *keep: str, only: np.ndarray | None = None) -> DataFrame:
    """The ``keep`` columns and the buckets of each text (those in ``only``, if given), as an array."""
    slim = docs.select(*keep, "text")
    schema = slim.drop("text").withColumn("buckets", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                doc, bucket = ngrams.of(texts)
                if only is not None:
                    used = np.isin(bucket, only)
                    doc, bucket = doc[used], bucket[used]
                offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], names=[*keep, "buckets"])

    return slim.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """(doc_id, y, text) of at most ``max_rows`` labelled documents for which ``usable`` (of doc_id) holds: those
    of the smallest hashes of their ids, one row of each id. The picked ids are bounded by max_rows, so they are broadcast."""
    picked = labels.where(usable & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return one_per_id(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """(doc_id, y, text): of rows that repeat an id the one of the least text, so that as many rows as ids reach a fit."""
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


@dataclass
class Rows:
    """Sparse training rows on the driver: bucket indices end to end, row offsets and labels."""

    bucket: np.ndarray
    offset: np.ndarray
    y: np.ndarray

    @classmethod
    def collect(cls, rows: DataFrame) -> Rows:
        """Of a bounded sample only, as Arrow arrays. Rows are put in an order that does not depend on partitions."""
        got = rows.select("doc_id", "y", "buckets").toArrow()
        ids = got.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i])))
        got = got.select(["y", "buckets"]).combine_chunks().take(pa.array(order, pa.int64())).combine_chunks()
        if not got.num_rows:
            return cls(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        lists = got.column("buckets").chunk(0)
        return cls(lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64), got.column("y").to_numpy().astype(np.int64))

    def row(self, i: int) -> np.ndarray:
        return self.bucket[self.offset[i] : self.offset[i + 1]]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.y), dtype=np.int32), np.diff(self.offset))

    def blocks(self, rows: int = 500) -> Iterator[tuple[int, int]]:
        """Ranges of rows, so that a pass over all of them needs little memory of its own."""
        return ((at, min(at + rows, len(self.y))) for at in range(0, len(self.y), rows))

    def counts(self, size: int) -> np.ndarray:
        """How many rows of y = 0 and of y = 1 have each bucket."""
        out = np.zeros((2, size), np.int64)
        for a, b in self.blocks():
            part, offset = self.bucket[self.offset[a] : self.offset[b]], self.offset[a : b + 1]
            y = np.repeat(self.y[a:b], np.diff(offset)) > 0
            out[1] += np.bincount(part[y], minlength=size)
            out[0] += np.bincount(part[~y], minlength=size)
        return out

    def take(self, which: np.ndarray) -> Rows:
        sizes = np.diff(self.offset)[which]
        flat = np.concatenate([self.row(i) for i in which]) if len(which) else self.bucket[:0]
        return Rows(flat, np.r_[0, np.cumsum(sizes)].astype(np.int64), self.y[which])


def bucket_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many rows of y = 0 and of y = 1 have each bucket: at most 2 * size sums reach the driver."""
    got = rows.select("y", F.explode("buckets").alias("bucket")).groupBy("y", "bucket").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros((2, size), np.int64)
    out[got.column("y").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def corpus_counts(docs: DataFrame, ngrams: NGrams) -> tuple[np.ndarray, int]:
    """How many texts of all rows have each bucket, and how many rows there are. A task adds up its own texts before the
    shuffle, and 2**bits sums reach the driver."""
    size = 1 << ngrams.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for _, texts in steps(batch, "text"):
                total += np.bincount(ngrams.of(texts)[1], minlength=size + 1)
                rows += len(texts)
        total[size] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out[:size], int(out[size])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) fits y, by Newton's method with Platt's smoothed targets."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    theta = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = sigmoid(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)
