"""More cases of the third round's findings."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [6, 1000])
def test_walks_from_hubs_give_the_same_scores_and_no_pair_moves(spark, monkeypatch, least):
    """Scores of seeds of any kind (a hub, several, one without edges) with hubs and with none, in blocks of queries."""
    rng = random.Random(7)
    one = {(f"m{k:02d}", f"h{rng.randrange(3)}") for k in range(40)} | {(f"m{k:02d}", f"m{(k * 7 + 3) % 40:02d}") for k in range(40) if k % 4}
    links = [(*e, rng.randrange(1, 9) / 4) for a, b in sorted(one) if a != b for e in ((a, b), (b, a))]
    edges = spark.createDataFrame(links, "a string, b string, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
    start = [(k, f"m{k * 3:02d}", 1.0) for k in range(8)] + [(8, "h1", 2.0), (8, "m05", 1.0), (9, "alone", 1.0), (9, "m00", 3.0), (10, "alone", 1.0)]
    seeds = spark.createDataFrame(start, "qid int, id string, mass double")
    monkeypatch.setattr(graph, "HUB_EDGES", least)
    monkeypatch.setattr(graph, "BLOCK_VALUES", 200)
    monkeypatch.setattr(graph, "STEP_VALUES", 20)
    want = {(r.qid, r.id): r.score for r in graph.pagerank(seeds, edges, 0.4, 6).collect()}
    found = graph.hub_pagerank(seeds, edges, 0.4, 6)
    got = {(r.qid, r.id): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange" not in plan(found).split("MapInArrow")[0] and "Join" not in plan(found)
    some = graph.hub_pagerank(seeds, edges, 0.4, 6, spark.createDataFrame([("h0",), ("m04",)], "id string"))
    assert {(r.qid, r.id) for r in some.collect()} == {k for k in want if k[1] not in ("h0", "m04")}


@pytest.mark.parametrize(("group", "share"), [(7, 0.0), (100, 0.05), (100, 2.0)])
def test_only_pairs_that_can_be_results_are_summed_exactly(monkeypatch, group, share):
    """Rows and queries of two languages; what each query's fifth row scores is known, so no step sums all of its pairs in double precision."""
    rng = np.random.default_rng(4)
    words = [f"{k}{i}" for k in "ab" for i in range(60)]
    some = lambda k: (rng.choice(60, int(rng.integers(1, 30))) ** 2 // 60 + 60 * (k % 2)).tolist()
    asked, rows = [sorted(set(some(k))) for k in range(50)], [some(k) for k in range(900)]
    rows[10:20] = [rows[1]] * 10  # ties
    lists = [list(dict.fromkeys(r)) for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([f"m{(k * 7) % 900:03d}" for k in range(900)]), pa.array([[words[t] for t in r] for r in lists]), pa.array([[r.count(t) for t in of] for r, of in zip(rows, lists, strict=True)]), pa.array([len(r) for r in rows])], names=["id", "terms", "counts", "length"])
    block = pa.table({"qid": pa.array(range(50)), "terms": pa.array([[words[t] for t in a] for a in asked])}).combine_chunks()
    monkeypatch.setattr(retrieval, "GROUP", group)
    monkeypatch.setattr(retrieval, "PAIR_SHARE", share)
    vocabulary, qids, guide, centres, lists_of = retrieval._grouped(block)
    doc, term, tf, size = retrieval._counted(batch, vocabulary)
    worth = {w: 0.3 + k / 7 for k, w in enumerate(words)}
    value = np.array([worth[w] for w in vocabulary.to_pylist()])[term] * tf / (tf + size / 9)
    every = {}
    for r, (of, i) in enumerate(zip(lists, batch.column("id").to_pylist(), strict=True)):
        for q, a in enumerate(asked):
            score = sum(worth[words[t]] * rows[r].count(t) / (rows[r].count(t) + len(rows[r]) / 9) for t in of if t in a)
            if score > 0:
                every.setdefault(q, []).append((-round(score, 9), i))
    want = {(q, i) for q, found in every.items() for s, i in found if s <= sorted(found)[:5][-1][0]}
    least = np.array([-sorted(every[q])[:5][-1][0] for q in qids.to_pylist()])
    monkeypatch.setattr(retrieval, "_added", lambda *a: pytest.fail("all pairs of a step are summed"))
    order, doc, term, value = retrieval._like_together(doc, term, value, 900, guide, centres)
    ids = batch.column("id").take(pa.array(order))
    got = set()
    for at in range(0, 900, 300):
        lo, hi = np.searchsorted(doc, [at, at + 300])
        found = retrieval._scores_of_step(doc[lo:hi] - at, term[lo:hi], value[lo:hi], lists_of, ids.slice(at, 300), qids, 5, least)
        got |= {(r["qid"], r["id"]) for r in found.to_pylist()}
    assert got == want
