"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def local_roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) into ``root`` (root[i] <= i), by pointer jumping; the smallest index leads."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root[:] = jumped
    return root


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: two orderable columns a, b. Returns (node, component): the smallest node that is
    reachable, for every node of an edge.

    A round joins each node's larger neighbours to its smallest one, then its smaller ones, which keeps
    components and takes a number of rounds logarithmic in the number of nodes. Minima are aggregated before the
    shuffle, so a hub is one row per task there; the join back is an equi-join whose large side has
    the hub's rows and can be split by AQE. Each round is written to the shared folder."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        last = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = materialize(small, "edges")
    raise RuntimeError("components did not settle")
