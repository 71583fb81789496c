"""federated_search against plain BM25 of both sources, and what its tasks hold."""

import math
from collections import Counter, defaultdict

import __spark_entry__
from lorekeep.operators import documents, retrieval


def plain_bm25(queries, texts, limit):
    """{qid: [(id, score)]}, by score of 9 digits and then id; texts without a term count for nothing."""
    rows = {i: Counter(retrieval.TERM.findall((t or "").lower())) for i, t in texts.items()}
    rows = {i: c for i, c in rows.items() if c}
    mean = sum(c.total() for c in rows.values()) / len(rows)
    df, out = Counter(t for c in rows.values() for t in c), {}
    for qid, text in queries.items():
        score = defaultdict(float)
        for t in set(retrieval.TERM.findall(text.lower())):
            for i, c in rows.items():
                if c[t]:
                    score[i] += math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
        out[qid] = sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda r: (-r[1], r[0]))[:limit]
    return out


def test_federated_search_is_plain_bm25_of_both_sources_and_makes_passages_once(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    found = __spark_entry__.queries()["federated_search"](spark, sf_dir)
    # a task that scores holds no second worker that makes passages: there are the two scoring steps alone
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    queries = {r.item_id: r.text for r in read("benchmark")}
    docs = {r.doc_id: r.text for r in read("documents")}
    memories = plain_bm25(queries, {f"m{i:07d}": t for i, t in docs.items() if i % 11}, 5)
    passages = plain_bm25(queries, {f"{i}#{c[0]:06d}": c[3] for i, t in docs.items() if t is not None for c in documents.chunk_text(t)}, 5)
    want = {("memory", q, k + 1): i for q, rows in memories.items() for k, (i, _) in enumerate(rows)}
    want |= {("document", q, k + 1): "{}:{}".format(i.split("#")[0], int(i.split("#")[1])) for q, rows in passages.items() for k, (i, _) in enumerate(rows)}
    rows = found.collect()
    assert {(r.kind, r.qid, r["rank"]): r.id for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.score - memories[r.qid][r["rank"] - 1][1]) < 1e-6 for r in rows if r.kind == "memory")
