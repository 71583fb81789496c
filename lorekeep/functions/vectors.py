"""Vectors of texts and of tables, without a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import words_of


def hashed_embedding(docs: DataFrame, id_: str = "id", text: str = "content", dims: int = 384) -> DataFrame:
    """(id, embedding): a signed bag of hashed words of length 1; a text without words is the first unit vector. For tests
    and offline use; a word's place is its FNV-1a hash modulo dims, its sign the hash's top bit. A row is made from its own
    text alone, without a shuffle of words."""
    rows = docs.select(F.col(id_).alias("key"), words_of(F.col(text)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED_ROWS):
                part = batch.slice(at, HASHED_ROWS)
                words = part.column("words")
                coded = words.flatten().dictionary_encode()
                h, many = _fnv(coded.dictionary.to_pylist())[coded.indices.to_numpy()], pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                cell = np.repeat(np.arange(part.num_rows), many) * dims + h % dims
                out = np.bincount(cell, np.where(h >= 1 << 31, -1.0, 1.0), part.num_rows * dims).astype(np.float64).reshape(part.num_rows, dims)
                out[many == 0, 0] = 1.0
                size = np.sqrt((out * out).sum(axis=1))
                out /= np.where(size > 0, size, 1.0)[:, None]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(np.arange(0, out.size + 1, dims, dtype=np.int32), out.reshape(-1))], names=[id_, "embedding"])

    return rows.mapInArrow(run, f"{id_} {docs.schema[id_].dataType.simpleString()}, embedding array<double>")


#: Rows that a task takes at once.
HASHED_ROWS = 1024


def _fnv(words: list[str]) -> np.ndarray:
    """32-bit FNV-1a over UTF-16 units of each word, as ``scalars.fnv1a``: all words take their first unit, then those that have one their second."""
    raw = [w.encode("utf-16-le", "surrogatepass") for w in words]
    sizes = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longer = len(words) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    h = np.full(len(words), 2166136261, np.int64)
    for i, n in enumerate(longer.tolist()):
        at = order[:n]
        h[at] = (h[at] ^ units[starts[at] + i]) * 16777619 & 0xFFFFFFFF
    return h


def centred(vectors: DataFrame, order: str, first: int = 256) -> DataFrame:
    """Vectors less the mean of the first ``first`` rows by ``order``; those rows pass unchanged. The mean is one row."""
    head = vectors.orderBy(order).limit(first)
    mean = head.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    bound = head.agg(F.max(order).alias("bound"), F.count("*").alias("n"))
    rows = vectors.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(bound))
    moved = F.zip_with("embedding", "mean", lambda x, m: (x - m).cast("double"))
    return rows.withColumn("embedding", F.when(F.col(order) > F.col("bound"), moved).otherwise(F.col("embedding").cast("array<double>"))).drop("mean", "bound", "n")


#: Pairs of a query map at most: they are solved on the driver, as one matrix of this many rows.
MAP_PAIRS = 256


def fit_query_map(pairs: DataFrame, ridge: float = 10.0) -> np.ndarray:
    """The matrix W of a kernel-ridge map, for which q + q W is near the memory that answers q. pairs: id, query, memory
    (vectors); the first MAP_PAIRS by id are fitted, as documented."""
    rows = pairs.orderBy("id").limit(MAP_PAIRS).select("query", "memory").collect()
    if not rows:
        raise ValueError("no pairs to fit")
    q, m = (np.array([r[k] for r in rows], dtype=np.float64) for k in (0, 1))
    return q.T @ np.linalg.solve(q @ q.T + ridge * np.eye(len(q)), m - q)


def map_queries(queries: DataFrame, matrix: np.ndarray, column: str = "embedding") -> DataFrame:
    """Queries with their vectors moved by the map and set to length 1. Null stays null."""

    @F.pandas_udf("array<double>")
    def moved(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            q = np.asarray(v, dtype=np.float64)
            out = q + q @ matrix
            return out / (np.linalg.norm(out) or 1.0)

        return vectors.map(one)

    return queries.withColumn(column, moved(column))
