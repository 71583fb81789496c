"""Embedding whitening from covariances that partitions merge.

Each partition makes its count, local mean and centred scatter, and its integer sums; two of them are merged by Chan's pairwise
formula in a treeReduce, so what reaches the driver is a few matrices of width x width, however many rows there are. The driver takes the
eigenvectors of the covariance. A second pass makes the same statistics of the whitened vectors and verifies that their covariance is
the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Eigenvalues of under this share of the trace are rounding, not directions: they get no component.
LEAST_SHARE = 1e-10
#: Levels of the treeReduce: the driver merges about the third root of the number of partitions.
DEPTH = 3
#: Numbers that a task holds at once, as vectors and as output rows.
STEP_VALUES = 1 << 20

#: count, integer sums, mean, centred scatter
Stats = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def stats_of(x: np.ndarray) -> Stats:
    """Count, sums, mean and centred scatter of the rows of ``x`` (one row at least)."""
    mean = x.mean(axis=0)
    centred = x - mean
    mean = mean + centred.mean(axis=0)  # what rounding left
    centred = x - mean
    return len(x), x.sum(axis=0).astype(object), mean, centred.T @ centred


def merged(a: Stats | None, b: Stats | None) -> Stats | None:
    """Chan's formula: the statistics of both sides' rows together."""
    if a is None or b is None:
        return a if b is None else b
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] / n * b[0])


def reduced(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, vector: str = "embedding") -> Stats | None:
    """``merged`` statistics of ``of`` (a matrix of vectors to one of numbers) over all rows; None if there are none."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Stats | None = None
        for batch in batches:
            for _, x in _matrices(batch, vector, width):
                held = merged(held, stats_of(of(x)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)])], names=["stats"])

    parts = rows.select(vector).mapInArrow(local, "stats binary").rdd.map(lambda row: pickle.loads(row[0]))
    return parts.treeAggregate(None, merged, merged, DEPTH)


def _matrices(batch: pa.RecordBatch, vector: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as double rows."""
    step = max(1, STEP_VALUES // width)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, part.column(part.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def as_integers(x: np.ndarray) -> np.ndarray:
    """The contract's numbers; those of entries beyond 2**36 stop at 2**42, so that a step's sums fit 64 bits."""
    return np.clip(np.floor(SCALE * x), -(1 << 42), 1 << 42).astype(np.int64) + SHIFT


def as_they_are(x: np.ndarray) -> np.ndarray:
    return x


@dataclass
class Whitening:
    """What a fit gives; its size is bounded by the vectors' width."""

    n: int
    total: np.ndarray  # sums of the numbers by dimension, as Python's own integers where those are integers
    mean: np.ndarray
    axes: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    values: np.ndarray  # their eigenvalues
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows in whitened coordinates: centred first, then projected and scaled."""
        return (x - self.mean) @ self.axes / np.sqrt(self.values)


def fit(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray] = as_they_are, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """The whitening of ``of`` of all rows' vectors (all of ``width``, finite). No rows, or rows that are all equal: no components."""
    stats = reduced(rows, of, width, vector)
    if stats is None:
        return Whitening(0, np.zeros(width, object), np.zeros(width), np.zeros((width, 0)), np.zeros(0), 0.0)
    n, total, mean, scatter = stats
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, axes, trace = values[::-1], axes[:, ::-1], float(np.trace(scatter)) / n
    most = min(components, int(np.count_nonzero(values > LEAST_SHARE * trace))) if trace > 0 else 0
    axes = axes[:, :most] * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)[:most]  # a sign that does not depend on the solver
    return Whitening(n, total, mean, axes, values[:most], trace)


def identity_error(rows: DataFrame, model: Whitening, width: int, of: Callable[[np.ndarray], np.ndarray] = as_they_are, vector: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance less the identity, from a pass over all rows."""
    if not len(model.values):
        return 0.0
    stats = reduced(rows, lambda x: model.apply(of(x)), width, vector)
    return float(np.abs(stats[3] / stats[0] - np.eye(len(model.values))).max())


def deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """Each integer row's sum over dimensions of (n x - total)**2, exactly."""
    lowest, highest = model.n * int(x.min()) - int(model.total.max()), model.n * int(x.max()) - int(model.total.min())
    if max(abs(lowest), abs(highest)) ** 2 * x.shape[1] < 1 << 62 and model.n * int(np.abs(x).max()) < 1 << 62:
        return pa.array(((model.n * x - model.total.astype(np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    wide = model.n * x.astype(object) - model.total
    return pa.array([int(v) for v in (wide * wide).sum(axis=1)], pa.decimal128(38, 0))


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector is there, has entries, and all of them are finite (and their number is ``width``)."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0 if width is None else F.size(vector) == width), F.lit(False))


def whitened(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal), whitened, explained and identity_error for each usable row and
    component. The numbers are floor(64 c) + 1000000 of each entry c; the covariance is over all usable rows, repeated ones included.

    Null vectors, vectors with null or non-finite entries and empty vectors are dropped; so are vectors of another width
    than the commonest (ties: the widest), as they have no covariance with the others. Directions without variance have no
    component: fewer than ``components`` rows come from narrow or dependent vectors, none from an empty table or from equal vectors. A null id is a
    row as any other; other columns are not read. Three passes over the vectors; nothing is shuffled but the partitions'
    matrices of width x width."""
    narrow = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))
    kind = narrow.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    widths = narrow.where(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("width")).count()
    common = widths.orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 1
    held = narrow.where(usable(F.col("embedding"), width))
    model = fit(held, width, as_integers, components)
    error = identity_error(held, model, width, as_integers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches if k else ():
            for part, values in _matrices(batch, "embedding", width):
                x = as_integers(values)
                out, m = model.apply(x), len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviations(model, x).take(row), pa.array(out.ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, schema)


def op13_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
