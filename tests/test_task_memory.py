"""What a task holds at once does not grow with its rows, its steps or the texts that it is given together."""

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.operators import documents, retrieval


def found_rows(query, k, score):
    """A step's rows of queries 0 to 39; their ids tell the step."""
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array([f"m{k:03d}-{i:06d}" for i in range(len(query))], pa.string()), pa.array(score)], names=["qid", "id", "score"])


def test_found_rows_are_cut_long_before_there_are_a_million():
    rng = np.random.default_rng(5)
    base, most, want = pa.total_allocated_bytes(), 0, {}

    def steps():
        nonlocal most
        for k in range(24):
            batch = found_rows(np.arange(50_000) % 40, k, rng.random(50_000))
            for q in range(40):
                score, ids = batch.column("score").to_numpy()[q::40], batch.column("id").to_pylist()[q::40]
                want[q] = sorted(want.get(q, []) + [(-score[i], ids[i]) for i in np.argsort(-score)[:5]])[:5]
            yield batch
            del batch
            most = max(most, pa.total_allocated_bytes() - base)

    got = sorted((r["qid"], -r["score"], r["id"]) for b in retrieval._trimmed(steps(), 5, 40) for r in b.to_pylist())
    assert got == [(q, *r) for q in range(40) for r in want[q]]
    assert most < 8 << 20


def test_steps_of_few_rows_are_not_held_one_by_one():
    live, most = [], 0

    def steps():
        nonlocal most
        for k in range(3000):
            batch = found_rows(np.array([k % 40]), k, np.array([float(k)])) if k % 3 else found_rows(np.zeros(0, np.int64), k, np.zeros(0))
            live.append(weakref.ref(batch))
            yield batch
            del batch
            if k % 100 == 0:
                most = max(most, sum(r() is not None for r in live))

    got = {(r["qid"], r["score"]) for b in retrieval._trimmed(steps(), 5, 40) for r in b.to_pylist()}
    assert got == {(q, float(k)) for q in range(40) for k in [k for k in range(3000) if k % 40 == q and k % 3][-5:]}
    assert most <= 300


def test_equal_vectors_tie_wherever_they_are(spark):
    """Products of matrices sum a row's last digits by its place; of equal rows those of the first ids are results, as in the SQL."""
    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(7, 61))
    rows = spark.createDataFrame([(f"m{i:04d}", kinds[i % 7].tolist()) for i in range(1003)], "id string, embedding array<double>").coalesce(2)
    q = spark.createDataFrame([(k, rng.normal(size=61).tolist()) for k in range(37)], "qid int, embedding array<double>")
    asked = {r.qid: np.array(r.embedding) for r in q.collect()}
    got = {}
    for r in retrieval.vector_lane(q, rows, 9).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    for k, v in asked.items():
        best = int(np.argmax(kinds @ v / np.linalg.norm(kinds, axis=1)))
        assert [i for _, i, _ in sorted(got[k])] == [f"m{best + 7 * n:04d}" for n in range(9)] and len({s for *_, s in got[k]}) == 1


def test_passages_are_made_once(spark):
    texts = [(1, "red fox. " * 400), (2, "blue fox. " * 300), (3, "")]
    rows = documents.chunks(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    q = spark.createDataFrame([(1, "red fox"), (2, "blue")], "qid int, text string")
    found = documents.search_documents(q, rows, 3, 1, "doc_id")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # that which scores
    assert found.where(F.col("content").isNull()).count() == 0
    pieces = {(d, c[0]): c[3] for d, t in texts for c in documents.chunk_text(t)}
    held = {(r.qid, r.doc_id, r.hit_index, r.chunk_index): r.content for r in found.collect()}
    assert {k[1] for k in held if k[0] == 2} == {2} and all(v == pieces[k[1], k[3]] for k, v in held.items())
    assert {k for k in held} == {(q, d, h, c) for q, d, h, _ in held for c in range(h - 1, h + 2) if (d, c) in pieces}


def test_texts_are_taken_apart_a_megabyte_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab " * 100_000, None, "c" * 10] * 20)], names=["low"])
    parts = list(retrieval.text_slices(batch, "low"))
    assert pa.Table.from_batches(parts).column("low").to_pylist() == batch.column("low").to_pylist()
    assert max(sum(len(t or "") for t in p.column("low").to_pylist()[:-1]) for p in parts) <= 1 << 20
