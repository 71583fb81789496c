"""Statistics of evaluation runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import xorshift
from ..scratch import kept

RESAMPLES, SEED = 10_000, 0xF157E


def accuracy(rows: DataFrame, category: str, correct: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def discordants(paired: DataFrame, *by: str) -> DataFrame:
    a, b = F.col("a_correct") == 1, F.col("b_correct") == 1
    return paired.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.avg((F.col("a_correct") - F.col("b_correct")).cast("double")).alias("delta"))


def mcnemar(paired: DataFrame, *by: str) -> DataFrame:
    """Two-sided exact p of the discordant pairs; the tail of the binomial is a sum over k in log space, in SQL."""
    rows = discordants(paired, *by).withColumns({"m": F.col("a_only") + F.col("b_only"), "k": F.least("a_only", "b_only")})
    # log of C(m, i) by the running sum of log((m - i + 1) / i)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("k")), F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("p")), lambda s, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(s["log_c"] + F.ln((F.col("m") - i + 1) / i)).alias("log_c"), (s["p"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(s["log_c"] + F.ln((F.col("m") - i + 1) / i)) - F.col("m") * math.log(2))).alias("p")), lambda s: s["p"])
    return rows.withColumn("p_value", F.when(F.col("m") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))).drop("m", "k")


def bootstrap(paired: DataFrame, by: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """95 % interval of the mean paired difference. A group is first brought to the counts of its differences, so a task
    draws multinomial resamples of a few counts and never holds the group's rows."""
    counts = paired.groupBy(by, (F.col("a_correct") - F.col("b_correct")).cast("double").alias("d")).agg(F.count("*").alias("n"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        n = int(rows.n.sum())
        drawn = np.random.default_rng(seed).multinomial(n, rows.n / n, size=resamples) @ rows.d.to_numpy() / n
        drawn.sort()
        return pd.DataFrame({by: [rows[by].iloc[0]], "n": [n], "delta": [float((rows.d * rows.n).sum() / n)], "low": [drawn[int(resamples * 0.025)]], "high": [drawn[int(resamples * 0.975)]]})

    kind = paired.schema[by].dataType.simpleString()
    return counts.groupBy(by).applyInPandas(draw, f"{by} {kind}, n long, delta double, low double, high double")


#: Resamples of one task, draws of one step inside it, and pairs of a group at most: a task holds a byte for each of its group's pairs.
BLOCK, STEP_DRAWS, MAX_PAIRS = 100, 1 << 20, 1 << 28


def _sums(differences: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """The sums of the resamples first to last (excluded), each of which takes as many draws as there are differences."""
    n = len(differences)
    total = np.zeros(last - first, np.int64)
    for at in range(first * n, last * n, STEP_DRAWS):
        stop = min(at + STEP_DRAWS, last * n)
        drawn = differences[xorshift.places(xorshift.draws(seed, at, stop - at), n)].astype(np.int64)
        starts = np.unique(np.concatenate([[at], np.arange(-(-at // n) * n, stop, n)]))
        total[starts // n - first] += np.add.reduceat(drawn, starts - at)
    return total


def bootstrap_exact(paired: DataFrame, by: str, key: str = "item_id", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """95 % interval of the mean paired difference per group, by one sequence of draws: resample r takes draws r * n to (r + 1) * n - 1 of a xorshift
    generator over the group's pairs in order of ``key`` (ties: by their difference). Same draws as a sequential run, digit by digit.

    A task skips ahead to its first draw and makes BLOCK resamples, so a group's resamples span many tasks. The group's differences go to each of
    them as a byte a pair; over MAX_PAIRS pairs are an error, as they would be 10**12 draws: ``bootstrap`` is for those. Pairs with a null on
    either side are left out."""
    d = (F.col("a_correct").cast("int") - F.col("b_correct").cast("int")).alias("d")
    rows = paired.select(F.col(by).alias("of"), F.col(key).alias("key"), d).where("d is not null")
    most = rows.groupBy("of").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_PAIRS:
        raise ValueError(f"a group has {most} pairs, more than {MAX_PAIRS}")
    of_type, kind = to_arrow_type(paired.schema[by].dataType), paired.schema[by].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], False
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now], of_type), pa.array([b"".join(held)])], names=["of", "packed"])
        for batch in batches:
            groups, values = batch.column("of").to_pylist(), batch.column("d").to_numpy().astype(np.int8)
            at = 0
            while at < len(groups):
                end = at + 1
                while end < len(groups) and groups[end] == groups[at]:
                    end += 1
                if seen and groups[at] != now:
                    yield one()
                    held = []
                now, seen = groups[at], True
                held.append(values[at:end].tobytes())
                at = end
        if seen:
            yield one()

    groups = kept(rows.repartition("of").sortWithinPartitions("of", "key", "d").select("of", "d").mapInArrow(packed, f"of {kind}, packed binary"), "bootstrap-pairs")
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // BLOCK)))).repartition(F.xxhash64("of", "block"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                d = np.frombuffer(batch.column("packed")[i].as_py(), np.int8)
                sums = _sums(d, block * BLOCK, min(resamples, (block + 1) * BLOCK), seed)
                fixed = [pa.array([len(d)] * len(sums)), pa.array([int(d.astype(np.int64).sum())] * len(sums))]
                yield pa.RecordBatch.from_arrays([batch.column("of").take(pa.array([i] * len(sums))), *fixed, pa.array(sums)], names=["of", "n", "all", "total"])

    drawn = blocks.select("of", "packed", "block").mapInArrow(draw, f"of {kind}, n bigint, all bigint, total bigint")
    counts = drawn.groupBy("of", "n", "all", "total").agg(F.count("*").alias("times"))
    upto = counts.withColumn("upto", F.sum("times").over(Window.partitionBy("of").orderBy("total")))
    out = upto.groupBy("of", "n", "all").agg(F.min(F.when(F.col("upto") > int(resamples * 0.025), F.col("total"))).alias("low"), F.min(F.when(F.col("upto") > int(resamples * 0.975), F.col("total"))).alias("high"))
    return out.select(F.col("of").alias(by), "n", (F.col("all") / F.col("n")).alias("delta"), (F.col("low") / F.col("n")).alias("low"), (F.col("high") / F.col("n")).alias("high"))


def comparable(a: DataFrame, b: DataFrame, key: str = "item_id") -> DataFrame:
    """Ids that only one of two runs has; empty if they can be compared."""
    return a.join(b, key, "left_anti").select(key, F.lit("a").alias("only_in")).union(b.join(a, key, "left_anti").select(key, F.lit("b")))


def publishable(run: DataFrame, max_failure_rate: float = 0.02) -> DataFrame:
    """The guards that a run breaks. run: item_id, failed_add, judge_error, failed (booleans)."""
    s = run.agg(F.count_if("failed_add").alias("adds"), F.count_if("judge_error").alias("errors"), F.avg(F.col("failed").cast("double")).alias("rate"))
    tests = F.array_compact(F.array(F.when(F.col("adds") > 0, "failed_adds"), F.when(F.col("errors") > 0, "judge_errors"), F.when(F.col("rate") > max_failure_rate, "failure_rate")))
    return s.select(F.explode(tests).alias("broken"))


def portfolio_gate(intervals: DataFrame, least: int = 2) -> DataFrame:
    """Whether enough datasets (delta, low) improve with an interval that is not under 0."""
    return intervals.agg(F.count_if((F.col("delta") > 0) & (F.col("low") >= 0)).alias("positive"), F.count("*").alias("datasets")).withColumn("passes", F.col("positive") >= least)


def hit_at_k(results: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """Per query: whether any target is among the first k results. results: qid, id, rank; targets: qid, id."""
    found = results.where(F.col("rank") <= k).join(targets, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("n"))
    return targets.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce(F.col("n") > 0, F.lit(False)).alias("hit"))


def inversions(ranks: np.ndarray, weights: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each group the sum of w_i * w_j over its pairs i before j with a greater rank first, exactly. Rows of a group lie together; groups are numbered
    from 0. A pair is met at the highest bit in which its ranks differ; rows are parted by one bit after another, as in a radix sort."""
    bits = int(ranks.max()).bit_length() if len(ranks) else 0
    key, total = (groups.astype(np.int64) << bits) | ranks, np.zeros(int(groups.max()) + 1 if len(groups) else 0, np.int64)
    w = weights.astype(np.int64)
    for bit in range(bits - 1, -1, -1):
        high = key >> (bit + 1)  # rows are in order of this
        one = key >> bit & 1
        before = np.cumsum(w * one) - w * one
        starts = np.flatnonzero(np.diff(high, prepend=high[0] - 1))
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(high))))
        of = high >> (bits - bit - 1)  # the group
        first = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        total[of[first]] += np.add.reduceat(w * (1 - one) * before, first)
        order = np.argsort(key >> bit, kind="stable")
        key, w = key[order], w[order]
    return total


def _inverted(rows: DataFrame, part: str, order: list[str], kind: str) -> DataFrame:
    """(of, d): discordant pairs of each group inside each part, whose rows are taken in ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        held = pa.Table.from_batches(got)
        of, parts = held.column("of").combine_chunks().dictionary_encode(null_encoding="encode"), held.column(part).to_numpy()
        codes = of.indices.to_numpy()
        change = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(parts, prepend=parts[0] - 1) != 0))
        group = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(codes))))
        ranks = np.unique(held.column("y").to_numpy(), return_inverse=True)[1]
        d = inversions(ranks, held.column("n").to_numpy(), group)
        yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(codes[change])), pa.array(d)], names=["of", "d"])

    return rows.repartition(part).sortWithinPartitions(part, "of", *order).select("of", part, "y", "n").mapInArrow(run, f"of {kind}, d bigint")


def kendall_tau_b(values: DataFrame, by: str) -> DataFrame:
    """tau-b of (x, y) per group, exact with ties; null if either side is constant. Rows with a null x or y are left out.

    Equal (x, y) are counted first. Discordant pairs are inversions of y in order of x: rows are dealt into ranges by (x, y), and inversions inside a
    range are counted there; those between two ranges are of two ranges of y, which a table of counts by both kinds of ranges gives, or of one, which are
    counted where that range of y lies. So a group of any size is spread over all tasks, in linear-logarithmic time."""
    cells = values.where("x is not null and y is not null").groupBy(F.col(by).alias("of"), "x", "y").agg(F.count("*").alias("n"))
    kind = values.schema[by].dataType.simpleString()
    rows = kept(cells.repartitionByRange("of", "x", "y").withColumn("part", F.spark_partition_id()), "tau-x")
    rows = kept(rows.repartitionByRange("of", "y", "x").withColumn("bucket", F.spark_partition_id()), "tau-y")
    counts = rows.groupBy("of", "part", "bucket").agg(F.sum("n").alias("n"))
    spans = counts.groupBy(F.col("of").alias("__of")).agg(F.count_distinct("part").alias("parts"), F.count_distinct("bucket").alias("buckets")).where("parts > 1 and buckets > 1")
    wide = counts.join(spans, F.col("of").eqNullSafe(F.col("__of"))).select("of", "part", "bucket", "n")

    def between(table: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(table["part"], return_inverse=True)[1], np.unique(table["bucket"], return_inverse=True)[1]
        m = np.zeros((a.max() + 1, b.max() + 1), np.int64)
        m[a, b] = table["n"]
        after = np.cumsum(m[::-1], axis=0)[::-1] - m  # in later parts
        below = np.cumsum(after, axis=1) - after  # and lower buckets
        return pd.DataFrame({"of": table["of"].iloc[:1], "d": [int((m * below).sum())]})

    found = _inverted(rows, "part", ["x", "y"], kind).unionByName(_inverted(rows, "bucket", ["part", "y"], kind)).unionByName(wide.groupBy("of").applyInPandas(between, f"of {kind}, d bigint"))
    square = lambda *keys: rows.groupBy("of", *keys).agg(F.sum("n").cast("decimal(19,0)").alias("m")).groupBy("of").agg(F.sum((F.col("m") * F.col("m")).cast("decimal(38,0)")).alias("m"))
    zero = F.lit(0).cast("decimal(38,0)")
    names = ("d", "all", "same_x", "same_y", "same")
    parts = [found.select("of", F.col("d").cast("decimal(38,0)").alias("d"))] + [square(*k).select("of", F.col("m").alias(n)) for n, k in zip(names[1:], ((), ("x",), ("y",), ("x", "y")), strict=True)]
    sums = reduce(DataFrame.unionByName, [p.select("of", *(F.col(n) if n in p.columns else zero.alias(n) for n in names)) for p in parts]).groupBy("of").agg(*(F.sum(n).cast("double").alias(n) for n in names))
    nx, ny = (F.col("all") - F.col("same_x")) / 2, (F.col("all") - F.col("same_y")) / 2
    apart = (F.col("all") - F.col("same_x") - F.col("same_y") + F.col("same")) / 2  # pairs that differ on both sides
    return sums.select(F.col("of").alias(by), F.when((nx > 0) & (ny > 0), (apart - 2 * F.col("d")) / F.sqrt(nx * ny)).alias("tau_b"))


def rubric_scores(verdicts: DataFrame, by: str) -> DataFrame:
    """Mean score of each group of rubric items; scores are cut to whole numbers but for event_ordering. verdicts: by,
    category, score."""
    score = F.when(F.col("category") == "event_ordering", F.col("score")).otherwise(F.signum("score") * F.floor(F.abs("score")))
    return verdicts.groupBy(by, "category").agg(F.avg(score).alias("score"), F.count("*").alias("items"))


def evidence_recall(contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per query: whether every evidence text is in the query's context (case and runs of white space aside). contexts: qid,
    context; evidence: qid, text. A query without a context recalls nothing."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    rows = evidence.join(contexts.select("qid", flat("context").alias("hay")), "qid", "left")
    return rows.groupBy("qid").agg(F.every(F.coalesce(F.col("hay").contains(flat("text")), F.lit(False))).alias("recalled"), F.count("*").alias("evidence"))


def event_ordering(rows: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, tau_norm and final to rows with two arrays of events, ``reference`` and ``system``. Events
    that one side lacks share the rank after the last; a tau that is not defined counts 0. Null arrays are empty, null events are left out.

    Events are taken apart, a row each, and ranked by their last place; the correlation is ``kendall_tau_b`` by row."""
    rows = kept(rows.withColumn("__row", F.monotonically_increasing_id()), "event-rows")
    side = lambda c, x: rows.select("__row", F.posexplode(c).alias("at", "event")).where("event is not null").groupBy("__row", "event").agg((F.max("at") + 1).alias(x), F.count("*").alias(f"{x}_times"))
    both = side("reference", "x").join(side("system", "y"), ["__row", "event"], "full")
    both = kept(both, "event-places")
    counts = both.groupBy("__row").agg(F.count("*").alias("every"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("same"), F.sum(F.when(F.col("x").isNull(), F.col("y_times")).otherwise(0)).alias("extra"), F.sum(F.when(F.col("y").isNull(), F.col("x_times")).otherwise(0)).alias("lost"))
    placed = both.join(counts, "__row").select("__row", F.coalesce("x", F.col("every") + 1).alias("x"), F.coalesce("y", F.col("every") + 1).alias("y"))
    found = rows.join(counts, "__row", "left").join(kendall_tau_b(placed, "__row"), "__row", "left")
    ratio = lambda n: F.when(F.col("same") + F.col(n) > 0, F.col("same") / (F.col("same") + F.col(n))).otherwise(0.0)
    found = found.withColumns({"precision": ratio("extra"), "recall": ratio("lost"), "tau_norm": F.coalesce((F.col("tau_b") + 1) / 2, F.lit(0.0))}).drop("every", "same", "extra", "lost", "tau_b", "__row")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return found.withColumn("f1", f1).withColumn("final", F.col("tau_norm") * F.col("f1"))


def matched_requirements(links: DataFrame) -> DataFrame:
    """Most requirements of each case that can be met if a fact meets one at most. links: case_id, requirement, fact (one row
    for each fact that would meet a requirement); a case is a handful of rows, matched in one task by augmenting paths."""

    def match(case):
        wants: dict = {}
        for r, f in zip(case["requirement"], case["fact"]):
            wants.setdefault(r, []).append(f)
        owner: dict = {}
        met = 0
        for start in wants:
            came, queue, free = {}, [start], None  # breadth first: fact -> the requirement that reached it
            while queue and free is None:
                r = queue.pop(0)
                for f in wants[r]:
                    if f in came:
                        continue
                    came[f] = r
                    if f not in owner:
                        free = f
                        break
                    queue.append(owner[f])
            met += free is not None
            held = {r: f for f, r in owner.items()}
            while free is not None:
                r = came[free]
                owner[free], free = r, held.get(r)
        return pd.DataFrame({"case_id": [case["case_id"].iloc[0]], "met": [met], "linked": [len(wants)]})

    kind = links.schema["case_id"].dataType.simpleString()
    return links.groupBy("case_id").applyInPandas(match, f"case_id {kind}, met long, linked long")
