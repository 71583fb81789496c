"""Near-duplicates by SimHash: 64-bit fingerprints linked through BK-trees over shards.

A link needs two fingerprints at 2 or fewer differing bits. Of the four 16-bit blocks of such a pair
at least two are equal, so every link lies inside a shard keyed by one of the six pairs of blocks and
their values. Each shard is indexed by a BK-tree: a node's children are keyed by their integer Hamming
distance to it, and a search follows only edges within the radius of the query's own distance. A shard
of more than ``SHARD_ROWS`` distinct fingerprints is cut into slices; each slice's tree, of bounded
size, is sent to the tasks of the shard's other slices, whose fingerprints query it. The trees travel by
the shard's key and not to every executor, because all trees together grow with the corpus.

Documents of equal fingerprint are one node; trees give spanning links of a shard, never its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, steps, table, unpacked
from .graph import components, local_roots
from .tokens import SLICE_BYTES

RADIUS = 2
SHINGLE = 3
SHARD_ROWS = 8192
#: Pairs of a query and a node that a search looks at together.
FRONTIER_ROWS = 1 << 16
#: Fingerprints that a task lays out as trees at once, besides the shard it is at.
TREE_ROWS = 65536
GAP = re.compile(rb"[\x20\x09-\x0D]")


def _counted(found: list[bytes], shingle: int, total: np.ndarray) -> int:
    """Adds the bits of the shingles' XXH64 (seed 42) to ``total``; returns how many there are."""
    parts = [found[i:] for i in range(shingle)]
    digest, n = xxhash.xxh64_digest, max(0, len(found) - shingle + 1)
    raw = b"".join([digest(s, 42) for s in map(b" ".join, zip(*parts, strict=False))])  # big-endian: bit 63 first
    for at in range(0, len(raw), 8 << 14):
        total += np.unpackbits(np.frombuffer(raw[at : at + (8 << 14)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return n


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64, repeats included; no words: 0. A long text is read in slices."""
    total, n, at, held = np.zeros(64, np.int64), 0, 0, []
    while at < len(text) or not at:
        gap = GAP.search(text, at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else None
        end = gap.end() if gap else len(text)
        held += text[at:end].lower().split()  # of bytes: A-Z only, and ASCII white space only
        if end < len(text):
            n += _counted(held, shingle, total)
            held = held[-(shingle - 1) :]
        elif not n and len(held) <= shingle:
            return xxhash.xxh64_intdigest(b" ".join(held), 42) if held else 0
        at = max(end, 1)
    n += _counted(held, shingle, total)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long. A null text has no words."""
    slim = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(fps)], names=[*keep, "fp"])

    return slim.mapInArrow(run, slim.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def _grow(fps: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The BK-trees of all groups at once. root: each row's first row of its group, rows of a group in
    order. Returns children: row by distance to the child's row, or -1. A round settles one level."""
    child = np.full((len(fps), 65), -1, np.int32)
    waiting = np.flatnonzero(root != np.arange(len(fps)))
    parent = root[waiting]
    while len(waiting):
        far = np.bitwise_count(fps[waiting] ^ fps[parent]).astype(np.int64)
        slot = parent.astype(np.int64) * 65 + far
        _, first = np.unique(slot, return_index=True)
        child.reshape(-1)[slot[first]] = waiting[first]
        settled = np.zeros(len(waiting), bool)
        settled[first] = True
        parent = child.reshape(-1)[slot][~settled]
        waiting = waiting[~settled]
    return child


def _search(fps: np.ndarray, child: np.ndarray, asks: np.ndarray, start: np.ndarray, roots: np.ndarray, radius: int) -> np.ndarray:
    """Joins each asking row with the rows of its tree within the radius, in ``roots``."""
    waiting = [(asks[at : at + FRONTIER_ROWS].astype(np.int32), start[at : at + FRONTIER_ROWS].astype(np.int32)) for at in range(0, len(asks), FRONTIER_ROWS)]
    while waiting:
        ask, node = waiting.pop()
        if len(ask) > FRONTIER_ROWS:  # depth first, in pieces: dense shards widen the frontier
            waiting += [(ask[at : at + FRONTIER_ROWS], node[at : at + FRONTIER_ROWS]) for at in range(0, len(ask), FRONTIER_ROWS)]
            continue
        far = np.bitwise_count(fps[ask] ^ fps[node]).astype(np.int32)
        hit = (far <= radius) & (ask != node)
        hit[hit] = roots[ask[hit]] != roots[node[hit]]
        roots = local_roots(ask[hit], node[hit], roots)
        onward = []
        for edge in range(-radius, radius + 1):
            d = far + edge
            inside = (d >= 0) & (d <= 64)
            next_ = child[node[inside], d[inside]]
            found = next_ >= 0
            onward.append((ask[inside][found], next_[found]))
        ask, node = (np.concatenate(x) for x in zip(*onward, strict=True))
        if len(ask):
            waiting.append((ask, node))
    return roots


def _shard_links(fps: np.ndarray, group: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of complete shards laid end to end. asks: 1 for rows of a slice that only query."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    start = np.repeat(first, np.diff(np.r_[first, len(group)]))
    tree = np.flatnonzero(asks == 0)
    if not len(tree):
        return fps[:0], fps[:0]
    where = np.full(len(fps), -1, np.int64)
    where[tree] = np.arange(len(tree))
    child = _grow(fps[tree], where[start[tree]])
    roots = np.arange(len(fps))
    # rows of the trees come first, so that a tree's own numbering is the rows' numbering
    order = np.r_[tree, np.flatnonzero(asks == 1)]
    moved = np.empty_like(order)
    moved[order] = np.arange(len(order))
    own = asks[start] == 0  # shards that have a tree
    has_asker = np.zeros(len(fps), bool)
    np.logical_or.at(has_asker, start, asks == 1)
    askers = np.flatnonzero(own & ((asks == 1) | ~has_asker[start]))
    roots = _search(fps[order], child, moved[askers], moved[start[askers]], roots, radius)
    a, b = order, order[roots]
    linked = a != b
    return fps[a[linked]], fps[b[linked]]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that have the components of all links."""
    block = [F.expr(f"shiftrightunsigned(fp, {16 * i}) & 65535") for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keyed = nodes.select("fp", F.explode(F.array(*[F.lit(k << 32) + F.shiftleft(block[i], 16) + block[j] for k, (i, j) in enumerate(pairs)])).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("slices", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    held = keyed.join(sizes, "shard").withColumn("slice", F.expr("cast(pmod(xxhash64(fp), slices) as int)"))
    # a slice is the tree of its own shard part, and queries the trees of the slices before it
    sent = held.select("fp", "shard", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    sent = sent.select("fp", "shard", F.least("slice", "other").alias("tree"), F.greatest("slice", "other").alias("asker"), (F.col("slice") > F.col("other")).cast("int").alias("asks"))
    keys = ["shard", "tree", "asker"]
    dealt = sent.repartition(*keys).sortWithinPartitions(*keys, "asks", "fp").select(*keys, "asks", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(block: np.ndarray) -> pa.RecordBatch:
            same = (block[1:, :3] == block[:-1, :3]).all(axis=1)
            group = np.r_[0, np.cumsum(~same)]
            lone = np.bincount(group)[group] < 2
            block, group = block[~lone], group[~lone]
            a, b = _shard_links(np.ascontiguousarray(block[:, 4]).view(np.uint64), group, block[:, 3], radius) if len(block) else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], schema=schema)

        for batch in batches:
            got = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            if not len(got):
                continue
            held.append(got)
            rows += len(got)
            if rows >= TREE_ROWS:
                block = np.concatenate(held)
                new = np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(axis=1))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield flush(block[:cut])
                held, rows = [block[cut:]], len(block) - cut
        if rows:
            yield flush(np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, fp, component (the least fingerprint of the group) and component_id (the smallest doc_id that links reach) for
    every row. docs: doc_id (of any type that has an order), text, and what ``keep`` names.

    A null or wordless text has fingerprint 0 and is linked like any other. Rows that repeat a doc_id
    each get a row. A null doc_id never leads a group that has another id; a group of null ids only
    has a null component_id. An empty table gives an empty table. Long texts are read in slices."""
    fps = materialize(fingerprints(docs, keep=keep), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return fps.join(named.join(least, "component").select("fp", "component", "component_id"), "fp").select(*keep, "fp", "component", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest doc_id (null last), then of the least
    text hash; of rows equal in both, any one. docs: doc_id, text and any others, whatever their names."""
    group = near_groups(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), radius, ("doc_id", "digest"))
    same = group.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest", "n")
    lead = same.groupBy("component").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("__near_id"), F.col("k.digest").alias("__near_digest"), F.col("k.n").alias("__near_n"))
    lead = materialize(lead, "near-leaders")
    rows = packed(docs, "doc_id", "text").withColumn("__near_hash", F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_hash") == F.col("__near_digest"))
    single = rows.join(lead.where("__near_n = 1"), match, "left_semi")
    repeated = lead.where("__near_n > 1")
    if repeated.isEmpty():
        return unpacked(single, docs.columns, ("doc_id", "text"))
    return unpacked(single.unionByName(rows.join(repeated, match, "left_semi").dropDuplicates(["doc_id", "__near_hash"])), docs.columns, ("doc_id", "text"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
