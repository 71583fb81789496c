"""Decay, pruning, demotion and consolidation of memories."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import trim_space
from ..scratch import kept

MAX_CONTENT = 50_000
#: Distinct vectors of a block in the search for near pairs.
BLOCK_ROWS = 2048
#: Pairs that one task of a matching walks, about.
WALK_PAIRS = 1 << 17


def days(later: Column, earlier: Column) -> Column:
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / 86_400_000.0


def decay(memories: DataFrame, now: Column) -> DataFrame:
    """importance after decay, and whether it is to be written (a change of at least 0.01). Identities keep theirs."""
    aged, idle = days(now, F.col("updated_at")), days(now, F.col("last_accessed_at"))
    boost = F.when(idle < 7, 1.1).when(idle > 30, 0.9).otherwise(1.0)
    decayed = F.least(F.greatest(F.col("importance") * (1 - F.least(0.05 * aged, F.lit(0.5))) * boost, F.lit(0.0)), F.lit(1.0))
    fresh = F.when(F.col("memory_type") == "identity", F.col("importance")).otherwise(decayed)
    write = F.abs(fresh - F.col("importance")) >= 0.01
    return memories.withColumn("decayed", F.when(write, fresh).otherwise(F.col("importance"))).withColumn("written", write)


def prunable(now: Column) -> Column:
    return (F.col("importance") < 0.1) & (days(now, F.col("created_at")) > 30) & (F.col("memory_type") != "identity")


def demote(memories: DataFrame, now: Column, ttl_days: float = 3.0, keep: int = 64) -> DataFrame:
    """Of a working set: rows not accessed within the TTL, then the least recent beyond ``keep`` per namespace."""
    order = Window.partitionBy("namespace_id").orderBy(F.desc("last_accessed_at"), "id")
    live = days(now, F.col("last_accessed_at")) <= ttl_days
    return memories.withColumn("demoted", ~live | (F.sum(live.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) > keep))


def merged_content(winner: Column, loser: Column) -> Column:
    w, l = F.regexp_replace(winner, r"(?U)\s+$", ""), F.regexp_replace(loser, r"(?U)\s+$", "")
    return F.when(w.contains(trim_space(loser)), w).otherwise(F.substring(F.concat(w, F.lit("\n\n"), l), 1, MAX_CONTENT))


def _near(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs (a, b) of a table of one or two blocks (reps, vectors) with a cosine of at least ``threshold``, one of each
    block; of a single block each pair once, and each vector with itself."""

    def unit(vectors: pa.ListArray) -> np.ndarray:
        sizes = np.diff(vectors.offsets.to_numpy())
        out = np.zeros((len(sizes), sizes.max(initial=0)))
        out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm != 0)

    def run(block: pa.Table) -> pa.Table:
        reps = [r.values for r in block.column("reps")]
        m = [unit(v.values) for v in block.column("vectors")]
        dims = min(x.shape[1] for x in m)
        i, j = np.nonzero(m[0][:, :dims] @ m[-1][:, :dims].T >= threshold)
        if len(m) == 1:
            i, j = i[i <= j], j[i <= j]
        return pa.table({"a": reps[0].take(pa.array(i)), "b": reps[-1].take(pa.array(j))})

    return run


def near_pairs(memories: DataFrame, threshold: float = 0.95) -> DataFrame:
    """All pairs of one namespace whose vectors have a cosine of at least ``threshold``: winner, loser, importance (of the
    winner). The winner has the higher importance, then the smaller id.

    Equal vectors are brought to one; the distinct ones of a namespace are dealt into blocks of about BLOCK_ROWS, and
    every two blocks meet in a task as one matrix product, so no pair is missed."""
    rows = kept(memories.where("embedding is not null and not forgotten and namespace_id is not null").select("id", "namespace_id", "importance", "embedding"), "near-rows")
    same = ["namespace_id", "embedding"]
    one = kept(rows.groupBy(*same).agg(F.min("id").alias("rep")), "near-distinct")
    parts = one.groupBy("namespace_id").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    dealt = one.join(parts, "namespace_id").withColumn("block", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
    blocks = kept(dealt.groupBy("namespace_id", "parts", "block").agg(F.collect_list("rep").alias("reps"), F.collect_list("embedding").alias("vectors")), "near-blocks")
    sent = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("namespace_id", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "reps", "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    found = sent.groupBy("namespace_id", "one", "two").applyInArrow(_near(threshold), f"a {kind}, b {kind}")
    members = rows.join(one, same).select("rep", F.struct("id", "importance").alias("m"))
    both = found.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").where("a <> b or x.id < y.id")
    ends = F.array_sort(F.array("x", "y"))
    p, q = F.col("ends")[0], F.col("ends")[1]
    first = (p["importance"] > q["importance"]) | ((p["importance"] == q["importance"]) & (p["id"] < q["id"]))
    out = both.select(ends.alias("ends")).select(F.when(first, p).otherwise(q).alias("w"), F.when(first, q).otherwise(p).alias("l"))
    return out.select(F.col("w.id").alias("winner"), F.col("l.id").alias("loser"), F.col("w.importance").alias("importance")).dropDuplicates(["winner", "loser"])


def merge_pairs(memories: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The pairs of ``near_pairs`` with their merged content: winner, loser, content."""
    of = memories.where("not forgotten").select("id", "content")
    pairs = near_pairs(memories, threshold).join(of.toDF("winner", "__w"), "winner").join(of.toDF("loser", "__l"), "loser")
    return pairs.select("winner", "loser", merged_content(F.col("__w"), F.col("__l")).alias("content"))


def rewire(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with losers replaced by winners, without loops, the largest weight of each (src, dst, relation)."""
    m = merged.select("winner", "loser")
    out = edges.join(m.withColumnRenamed("loser", "src").withColumnRenamed("winner", "__s"), "src", "left").withColumn("src", F.coalesce("__s", "src")).drop("__s")
    out = out.join(m.withColumnRenamed("loser", "dst").withColumnRenamed("winner", "__d"), "dst", "left").withColumn("dst", F.coalesce("__d", "dst")).drop("__d")
    return out.where("src <> dst").groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"))


def reinforce(edges: DataFrame, pairs: DataFrame, eta: float = 0.1, cap: float = 0.95) -> DataFrame:
    """Hebbian step for unordered pairs (a, b): an edge between them moves to the cap by eta, a missing one starts at eta."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    have = edges.withColumns({"a": low, "b": high}).groupBy("a", "b").agg(F.max_by("weight", F.struct("src", "dst", "relation")).alias("w"))
    asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return asked.join(have, ["a", "b"], "left").select("a", "b", F.when(F.col("w").isNull(), F.lit(eta)).otherwise(F.least(F.lit(cap), F.col("w") + eta * (cap - F.col("w")))).alias("weight"), F.col("w").isNull().alias("created"))


def typed_edges(memories: DataFrame, key: list[str], relation: str, weight: float, most: int = 4) -> DataFrame:
    """Each memory to the (up to ``most``) rows before it that share its key, most recent first; a window over the
    key's rows in order, so no pairs are made."""
    order = Window.partitionBy(*[F.lower(k) for k in key]).orderBy("created_at", "id")
    rows = memories.where(" and ".join(f"{k} is not null" for k in key)).withColumn("before", F.collect_list("id").over(order.rowsBetween(-most, -1)))
    return rows.select(F.col("id").alias("src"), F.explode("before").alias("dst"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs in order: those with both ends free."""
    used = set()
    for batch in batches:
        took = []
        for w, l in zip(batch.column("winner").to_pylist(), batch.column("loser").to_pylist(), strict=True):
            took.append(w not in used and l not in used)
            if took[-1]:
                used |= {w, l}
        yield batch.filter(pa.array(took, pa.bool_()))


def greedy_matching(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """One partner per row: the pairs that a walk in ``order`` would take, skipping those with an end already taken. pairs:
    winner, loser and more.

    Pairs are sorted and numbered once. A round walks the first WALK_PAIRS or so in one task, which holds the ends taken
    there alone, and drops all pairs that touch a taken row; the result is that of the walk. Rounds are written, so that a lost
    executor costs one round; there are at most pairs / WALK_PAIRS, fewer as pairs are dropped, whatever the order."""
    cols = pairs.columns
    left = kept(pairs.orderBy(*order, "winner", "loser").withColumn("__at", F.monotonically_increasing_id()), "matching")
    taken = []
    while n := left.count():
        share = WALK_PAIRS / n
        head = rest = left
        if share < 1:
            cut = left.approxQuantile("__at", [share], share / 8)[0]
            head, rest = left.where(F.col("__at") <= cut), left.where(F.col("__at") > cut)
        chosen = kept(head.repartition(1).sortWithinPartitions("__at").mapInArrow(_walk, head.schema), "matched")
        taken.append(chosen.select(*cols))
        if share >= 1:
            break
        used = F.broadcast(chosen.select(F.explode(F.array("winner", "loser")).alias("end")))  # of one walk: bounded
        left = kept(rest.join(used.withColumnRenamed("end", "winner"), "winner", "left_anti").join(used.withColumnRenamed("end", "loser"), "loser", "left_anti"), "matching")
    return reduce(DataFrame.unionByName, taken, pairs.limit(0))
