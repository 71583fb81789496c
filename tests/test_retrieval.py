"""Lanes and walks against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph, lifecycle, retrieval

DAY = dt.datetime(2024, 3, 1)


def dense(links, seeds, rounds=200):
    """PageRank of (a, b, w) links from {id: mass}, by a dense matrix."""
    names = sorted({x for a, b, _ in links for x in (a, b)} | set(seeds))
    at = {n: k for k, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, x in links:
        w[at[a], at[b]] += x
    out = w.sum(1, keepdims=True)
    move = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    seed = np.zeros(len(names))
    for i, m in seeds.items():
        seed[at[i]] = m / sum(seeds.values())
    p = seed
    for _ in range(rounds):
        p = 0.5 * seed + 0.5 * (p @ move + p[out[:, 0] == 0].sum() * seed)
    return {n: p[at[n]] for n in names}


@pytest.fixture(scope="module")
def links():
    """A random undirected graph with a hub and a part of its own."""
    rng = random.Random(7)
    both = {(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(110)} | {("hub", f"n{i:02d}") for i in range(60)} | {("x1", "x2")}
    return [(a, b, w) for a, b in both if a != b and (b, a) not in both for w in [rng.randint(1, 9) / 3] for a, b in ((a, b), (b, a))]


def walked(spark, links, seeds, **limits):
    rows = [(q, i, m) for q, of in seeds.items() for i, m in of.items()]
    found = graph.walk(spark.createDataFrame(rows, "qid int, id string, mass double"), spark.createDataFrame(links, "a string, b string, w double"), **limits).collect()
    out = {}
    for r in found:
        out.setdefault(r.qid, []).append(r)
    return out


SEEDS = {1: {"n00": 1.0}, 2: {"n03": 0.4, "n17": 0.9, "alone": 0.7}, 3: {"hub": 1.0}, 4: {"alone": 2.0}, 5: {"x1": 1.0}}


def test_a_fine_walk_is_the_dense_walk(spark, links):
    got = walked(spark, links, SEEDS, epsilon=1e-9, hops=40, rounds=24, limit=500)
    for q, of in SEEDS.items():
        want = dense(links, of)
        assert {r.id for r in got[q]} == {n for n, p in want.items() if p > 1e-9}
        assert all(abs(r.score - want[r.id]) < 1e-6 and r.slack < 1e-5 for r in got[q])
        assert [r.rank for r in got[q]] == sorted(r.rank for r in got[q])


@pytest.mark.parametrize("limits", [{"epsilon": 1e-2}, {"epsilon": 1e-3}, {"epsilon": 1e-3, "hops": 1}, {"epsilon": 1e-4, "rounds": 3}])
def test_scores_are_within_the_slack(spark, links, limits):
    got = walked(spark, links, SEEDS, limit=500, **limits)
    for q, of in SEEDS.items():
        want, slack = dense(links, of), got[q][0].slack
        assert sum(r.score for r in got[q]) + slack == pytest.approx(1, abs=1e-6)
        assert all(r.score <= want[r.id] + 1e-8 and want[r.id] <= r.score + slack + 1e-8 for r in got[q])
        # a query reaches so many nodes at most, whatever its hubs are
        assert len(got[q]) <= len(of) + 2 / limits["epsilon"]


def test_a_hub_over_the_bound_is_not_walked(spark):
    star = [(a, b, 1.0) for i in range(3000) for a, b in (("hub", f"m{i}"), (f"m{i}", "hub"))]
    got = walked(spark, star, {1: {"m7": 1.0}, 2: {"hub": 1.0}}, limit=5000)
    assert {r.id for r in got[1]} == {"m7", "hub"} and {r.id for r in got[2]} == {"hub"}


def test_walk_takes_no_seeds_ties_and_targets(spark, links):
    assert walked(spark, links, {1: {"n00": 0.0}}) == {}
    square = [(a, b, 1.0) for x, y in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")) for a, b in ((x, y), (y, x))]
    seeds = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "qid int, id string, mass double")
    edges = spark.createDataFrame(square, "a string, b string, w double")
    got = graph.walk(seeds, edges, limit=2, targets=spark.createDataFrame([("b",), ("c",), ("d",)], "id string")).collect()
    assert [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [("b", 1), ("c", 2)] and got[0].score == got[1].score


def test_named_entities(spark):
    q = spark.createDataFrame([(1, "Where does Ada Lovelace live?"), (2, "lovelace and then ada"), (3, "nobody"), (4, None)], "qid int, text string")
    e = spark.createDataFrame([("e1", "Ada Lovelace"), ("e2", "ada"), ("e3", "  "), ("e4", "or")], "id string, name string")
    assert {(r.qid, r.entity_id) for r in lifecycle.named_entities(q, e).collect()} == {(1, "e1"), (1, "e2"), (2, "e1"), (2, "e2")}


def test_ties_do_not_leave_a_batch(spark):
    """Of rows that tie with the last place only those of the smallest ids go on."""
    scores, ids = np.zeros((20_000, 3)), [f"r{(i * 7919) % 20_000:05d}" for i in range(20_000)]
    scores[:, 1] = [i % 2 for i in range(20_000)]
    scores[5:, 2] = -np.inf
    import pyarrow as pa

    got = retrieval._best(scores, pa.array(ids), pa.array([1, 2, 3]), 50).to_pylist()
    by = {q: sorted((r["id"] for r in got if r["qid"] == q)) for q in (1, 2, 3)}
    assert by[1] == sorted(ids)[:50] and by[2] == sorted(ids[1::2])[:50] and by[3] == sorted(ids[:5])
    same = spark.range(4000).select(F.format_string("m%05d", "id").alias("id"), F.lit("one text twice over").alias("content"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    q = spark.createDataFrame([(1, "one text", [0.0, 0.0]), (2, "twice", [1.0, 0.0])], "qid int, text string, embedding array<double>")
    for lane in (retrieval.vector_lane(q, same, 7), retrieval.bm25_lane(q, same, 7)):
        assert sorted((r.qid, r.id) for r in lane.collect()) == [(k, f"m{i:05d}") for k in (1, 2) for i in range(7)]


def test_a_task_keeps_the_best_of_all_its_steps(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(rng.randrange(6), f"m{k:04d}", float(rng.randrange(9))) for k in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 60], strict=True)], names=["qid", "id", "score"]) for a in range(0, 900, 60)]
    want = {(q, i) for q in range(6) for _, i in sorted((-s, i) for p, i, s in rows if p == q)[:5]}
    for room in (0, 100, 1 << 20):
        monkeypatch.setattr(retrieval, "STEP_VALUES", room)
        assert {(r["qid"], r["id"]) for b in retrieval._trimmed(iter(batches), 5, 6) for r in b.to_pylist()} == want
    assert list(retrieval._trimmed(iter([]), 5, 6)) == []


def test_dense_and_rare_terms_add_up_alike(monkeypatch):
    rng = np.random.default_rng(1)
    n, rows, terms = 40, 30, 90
    lists = [np.sort(rng.choice(n, int(rng.integers(0, n)), replace=False)) for _ in range(terms)]
    first, of = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)
    pairs = np.unique(rng.integers(0, rows * terms, 700))
    doc, term, weight = pairs // terms, pairs % terms, rng.random(len(pairs))
    want = np.zeros((rows, n))
    for d, t, w in zip(doc, term, weight, strict=True):
        want[d, lists[t]] += w
    for share in (0.0, 0.4, 2.0):
        for most in (3, 256):
            monkeypatch.setattr(retrieval, "DENSE_SHARE", share)
            monkeypatch.setattr(retrieval, "DENSE_TERMS", most)
            monkeypatch.setattr(retrieval, "STEP_VALUES", 50)
            assert np.allclose(retrieval._added(doc, term, weight, first, of, rows, n), want)


def brute_temporal(queries, rows, tau, limit):
    out = {}
    for q, a, b in queries:
        if a is None or b is None:
            continue
        if tau <= 0:
            hits = sorted((r for r in rows if r[1] and a <= r[1] <= b), key=lambda r: (r[2], r[0]), reverse=True)
            out |= {(q, r[0]): 1 - i / len(hits) for i, r in enumerate(hits[:limit])}
            continue
        reach = dt.timedelta(days=int(3 * tau))
        near = [(math.exp(-max(0, (a - r[1]) / dt.timedelta(days=1), (r[1] - b) / dt.timedelta(days=1)) / tau), r[0]) for r in rows if r[1] and a - reach <= r[1] <= b + reach]
        out |= {(q, i): s for s, i in sorted((x for x in near if x[0] > 0.01), key=lambda x: (-x[0], x[1]))[:limit]}
    return out


@pytest.mark.parametrize("tau,limit", [(7.0, 5), (2.0, 50), (0.0, 4), (0.0, 500), (7.0, 500)])
def test_temporal_lane_equals_brute_force(spark, tau, limit):
    rng = random.Random(11)
    moment = lambda: DAY + dt.timedelta(hours=rng.randrange(24 * 90), minutes=rng.choice([0, 0, 30]))
    rows = [(f"m{i:03d}", None if i % 9 == 0 else DAY + dt.timedelta(days=40) if i % 3 == 0 else moment(), DAY + dt.timedelta(days=i % 17)) for i in range(400)]
    queries = [(i, a, a + dt.timedelta(hours=rng.choice([0, 1, 30, 24 * 12]))) for i in range(25) for a in [moment()]] + [(90, DAY + dt.timedelta(days=40), DAY + dt.timedelta(days=40)), (91, None, DAY), (92, DAY + dt.timedelta(days=9), DAY)]
    q = spark.createDataFrame(queries, "qid int, `from` timestamp, `to` timestamp")
    m = spark.createDataFrame(rows, "id string, event_date timestamp, created_at timestamp")
    got = {(r.qid, r.id): r.score for r in retrieval.temporal_lane(q, m, tau, limit).collect()}
    want = brute_temporal([x for x in queries if x[0] != 92], rows, tau, limit)
    got = {k: v for k, v in got.items() if k[0] != 92}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_temporal_join_is_one_of_equal_days(spark):
    q = spark.range(100_000).select(F.col("id").alias("qid"), F.timestamp_seconds(F.col("id") * 60).alias("from"), F.timestamp_seconds(F.col("id") * 60 + 3600).alias("to"))
    m = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 1200).alias("event_date"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    plan = retrieval.temporal_lane(q, m)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
