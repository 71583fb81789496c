"""Exact bootstrap and rank correlation against sequential versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import xorshift
from lorekeep.operators import evaluation


def sequence(seed):
    s = seed or 1
    while True:
        s ^= (s << 13) & 0xFFFFFFFF
        s ^= s >> 17
        s ^= (s << 5) & 0xFFFFFFFF
        yield s


def test_draws_can_be_reached_from_anywhere():
    made = sequence(evaluation.SEED)
    want = np.array([next(made) for _ in range(20_000)], np.uint32)
    for first, count in ((0, 20_000), (1, 1), (255, 600), (7777, 4097), (19_999, 1), (5, 0)):
        assert (xorshift.draws(evaluation.SEED, first, count) == want[first : first + count]).all()
    assert (xorshift.draws(0, 3, 9) == xorshift.draws(1, 3, 9)).all()
    far = xorshift.draws(9, 10**15, 4)
    assert (xorshift.times(xorshift.power(10**15 + 1), np.array([9], np.uint32)) == far[:1]).all() and (xorshift.step(far[:3]) == far[1:]).all()
    assert xorshift.places(np.array([0, 0xFFFFFFFF], np.uint32), 7).tolist() == [0, 6]


def sequential_bootstrap(d, resamples):
    draw, means = sequence(evaluation.SEED), []
    for _ in range(resamples):
        means.append(sum(d[min(math.floor(next(draw) / 0xFFFFFFFF * len(d)), len(d) - 1)] for _ in d) / len(d))
    means.sort()
    return len(d), sum(d) / len(d), means[int(resamples * 0.025)], means[int(resamples * 0.975)]


@pytest.mark.parametrize("resamples,step", [(10_000, 1 << 20), (1000, 77), (950, 1 << 20)])
def test_bootstrap_equals_the_sequential_one(spark, monkeypatch, resamples, step):
    rng = random.Random(resamples)
    rows = [(i, c, rng.randrange(2), rng.randrange(2)) for i in range(90) for c in ("a", "b", None) if rng.random() < 0.6]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (1000, "a", None, 1), (1001, "one", 1, 0)], "item_id long, category string, a_correct int, b_correct int").repartition(5)
    monkeypatch.setattr(evaluation, "STEP_DRAWS", step)
    got = {r.category: tuple(r)[1:] for r in evaluation.bootstrap_exact(df, "category", resamples=resamples).collect()}
    want = {c: sequential_bootstrap([a - b for _, k, a, b in sorted(rows, key=lambda r: r[0]) if k == c], resamples) for c in ("a", "b", None)}
    assert got == want | {"one": (1, 1.0, 1.0, 1.0)}
    monkeypatch.setattr(evaluation, "MAX_PAIRS", 3)
    with pytest.raises(ValueError, match="pairs"):
        evaluation.bootstrap_exact(df, "category")


def brute_tau(points):
    s = nx = ny = 0
    for i, (x, y) in enumerate(points):
        for u, v in points[:i]:
            s += ((x > u) - (x < u)) * ((y > v) - (y < v))
            nx += x != u
            ny += y != v
    return s / math.sqrt(nx * ny) if nx and ny else None


def test_inversions_are_counted_by_group():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        group, rank, w = np.sort(rng.integers(0, 4, n)), rng.integers(0, int(rng.integers(1, 30)), n), rng.integers(1, 5, n)
        group = np.unique(group, return_inverse=True)[1]
        want = [sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if group[i] == group[j] == g and rank[i] > rank[j]) for g in range(group.max() + 1)]
        assert evaluation.inversions(rank, w, group).tolist() == want


@pytest.mark.parametrize("partitions", [1, 5, 17])
def test_tau_equals_all_pairs(spark, partitions):
    rng = random.Random(partitions)
    points = {"hot": [(rng.randrange(40), rng.choice([0.5, 1.5, rng.random()])) for _ in range(400)], "tied": [(1, k % 3) for k in range(9)], "two": [(1, 2.0), (2, 1.0)], "one": [(1, 1.0)], None: [(k, -k / 7 + rng.random()) for k in range(50)]}
    points |= {f"g{k}": [(rng.randrange(4), float(rng.randrange(3))) for _ in range(rng.randrange(1, 8))] for k in range(30)}
    rows = [(g, x, float(y)) for g, p in points.items() for x, y in p] + [("hot", None, 1.0), ("hot", 1, None)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.tau_b for r in evaluation.kendall_tau_b(spark.createDataFrame(rows, "g string, x int, y double"), "g").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got.keys() == points.keys()
    for g, p in points.items():
        want = brute_tau(p)
        assert got[g] is None if want is None else math.isclose(got[g], want, abs_tol=1e-12)


def test_tau_of_a_million_rows(spark):
    """One group, without ties and with: a permutation whose discordant pairs are known."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("x"), (F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("y"))
    assert math.isclose(evaluation.kendall_tau_b(rows, "g").first().tau_b, 1 - 4 * (n // 2) / (n * (n - 1)), rel_tol=1e-12)
    flat = rows.select("g", F.floor(F.col("x") / 1000).alias("x"), F.floor(-F.col("x") / 1000).alias("y"))
    assert -1 <= evaluation.kendall_tau_b(flat, "g").first().tau_b < -0.99


def test_event_ordering_of_odd_rows(spark):
    rows = [(1, ["a", "b", "c"], ["a", "b", "c"]), (2, ["a", "b"], ["b", "a"]), (3, [], []), (4, None, ["a"]), (5, ["a", "a", "b"], ["b", "x", "x"]), (6, ["a"], ["a"]), (7, ["a", None, "b"], ["a", "b"])]
    got = {r.k: r for r in evaluation.event_ordering(spark.createDataFrame(rows, "k int, reference array<string>, system array<string>")).collect()}
    assert (got[1].f1, got[1].tau_norm, got[1].final) == (1, 1, 1) and (got[2].tau_norm, got[2].f1) == (0, 1)
    assert got[3].final == got[4].final == 0 and (got[6].tau_norm, got[6].f1) == (0, 1) and got[7].final == 1
    # a last at 2, b at 3; b at 1, x at 3; a lacks in one, x in the other: ranks (2, 4), (3, 1), (4, 3)
    assert math.isclose(got[5].precision, 1 / 3) and math.isclose(got[5].recall, 1 / 3) and math.isclose(got[5].tau_norm, (brute_tau([(2, 4), (3, 1), (4, 3)]) + 1) / 2)
