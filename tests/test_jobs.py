"""Write jobs, second rounds and evaluation against brute force on small cases."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import vectors
from lorekeep.operators import analytics, beliefs, documents, evaluation, fusion, graph, maintenance, retrieval

DAY = dt.datetime(2024, 1, 1)


def test_greedy_matching(spark):
    """The rounds take what a walk over the ordered pairs takes."""
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)})
    rows = [(f"m{a:02}", f"m{b:02}", rng.randrange(5) / 4) for a, b in pairs]
    want, used = [], set()
    for w, l, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {w, l} & used:
            used |= {w, l}
            want.append((w, l))
    df = spark.createDataFrame(rows, "winner string, loser string, importance double")
    got = maintenance.greedy_matching(df, [-F.col("importance")])
    assert sorted((r.winner, r.loser) for r in got.collect()) == sorted(want)
    assert maintenance.greedy_matching(df.limit(0), [-F.col("importance")]).count() == 0


def walked(rows):
    want, used = [], set()
    for w, l, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {w, l} & used:
            used |= {w, l}
            want.append((w, l))
    return sorted(want)


def test_greedy_matching_of_cliques(spark, monkeypatch):
    """A clique with pairs to rows outside it is matched as by the walk, in few rounds although its pairs follow each other."""
    rng = random.Random(11)
    pairs = set(itertools.combinations(range(50), 2)) | {tuple(sorted((rng.randrange(50), rng.randrange(50, 90)))) for _ in range(12)} | {tuple(sorted(rng.sample(range(50, 120), 2))) for _ in range(60)}
    rank = {i: rng.randrange(7) / 8 for i in range(120)}
    rows = [(f"m{a:03}", f"m{b:03}", rank[a]) if rank[a] >= rank[b] else (f"m{b:03}", f"m{a:03}", rank[b]) for a, b in pairs]
    names = []
    monkeypatch.setattr(maintenance, "WALK_PAIRS", 300)
    monkeypatch.setattr(maintenance, "kept", lambda df, name, keep=maintenance.kept: names.append(name) or keep(df, name))
    got = maintenance.greedy_matching(spark.createDataFrame(rows, "winner string, loser string, importance double"), [-F.col("importance")])
    assert sorted((r.winner, r.loser) for r in got.collect()) == walked(rows)
    assert 1 < names.count("matched") < 7


def test_near_pairs(spark, sf_dir, monkeypatch):
    """Recall against brute force at the threshold that the query is registered with, over several blocks, equal vectors too."""
    from lorekeep.sources.views import load

    monkeypatch.setattr(maintenance, "BLOCK_ROWS", 40)
    some = load(spark, sf_dir, "memories").select("id", "namespace_id", "importance", "content", "embedding", "forgotten").where("embedding is not null")
    again = some.where("importance < 0.1").withColumn("id", F.concat(F.lit("x"), "id"))
    df = some.union(again)
    rows = [r for r in df.collect() if not r.forgotten]
    v = np.array([r.embedding for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.35, 1))):
        a, b = sorted((rows[i], rows[j]), key=lambda r: (-r.importance, r.id))
        if a.namespace_id == b.namespace_id:
            want.add((a.id, b.id))
    got = [(r.winner, r.loser) for r in maintenance.merge_pairs(df, 0.35).collect()]
    assert len(want) > 20 and len(got) == len(set(got))
    assert len(want & set(got)) / len(want) >= 0.9 and set(got) == want


def test_matched_requirements(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for case in range(25):
        links = sorted({(rng.randrange(5), rng.randrange(5)) for _ in range(7)})
        rows += [(case, r, f) for r, f in links]
        wants = sorted({r for r, _ in links})
        want[case] = max(
            n for n in range(len(wants) + 1) for some in itertools.combinations(links, n)
            if len({r for r, _ in some}) == n == len({f for _, f in some})
        )
    got = evaluation.matched_requirements(spark.createDataFrame(rows, "case_id int, requirement int, fact int"))
    assert {r.case_id: r.met for r in got.collect()} == want


@pytest.mark.parametrize(
    ("ref", "out", "tau", "f1"),
    [
        (["a", "b", "c"], ["a", "b", "c"], 1.0, 1.0),
        (["a", "b", "c"], ["c", "b", "a"], 0.0, 1.0),
        (["a"], ["a"], 0.0, 1.0),  # no pair: tau is not defined
        (["a", "b"], ["c"], None, 0.0),
        ([], [], 0.0, 0.0),
    ],
)
def test_event_ordering(spark, ref, out, tau, f1):
    df = spark.createDataFrame([(ref, out)], "reference array<string>, system array<string>")
    row = evaluation.event_ordering(df).first()
    assert row.f1 == pytest.approx(f1)
    assert tau is None or row.tau_norm == pytest.approx(tau)
    assert row.final == pytest.approx(row.tau_norm * row.f1)


def test_rubric_and_evidence(spark):
    v = spark.createDataFrame([(1, "event_ordering", 0.5), (1, "event_ordering", 1.0), (2, "x", -0.9), (2, "x", 1.9)], "q int, category string, score double")
    assert {r.q: r.score for r in evaluation.rubric_scores(v, "q").collect()} == {1: 0.75, 2: 0.5}
    contexts = spark.createDataFrame([(1, "The  CAT\nsat"), (2, "dog")], "qid int, context string")
    evidence = spark.createDataFrame([(1, "the cat"), (1, "cat sat "), (2, "dog"), (2, "cat"), (3, "x")], "qid int, text string")
    assert {r.qid: r.recalled for r in evaluation.evidence_recall(contexts, evidence).collect()} == {1: True, 2: False, 3: False}


def whole_transcript(text, most, overlap):
    """(start, end) of the pieces, from the whole text."""
    found, start = [], 0
    while text:
        end = min(start + most, len(text))
        if end == len(text):
            return [*found, (start, end)]
        breaks = [i for i in range(start + most // 2 + 1, end + 1) if text[i] == "\n"]
        end = breaks[-1] if breaks else end
        found.append((start, end))
        after = [i + 1 for i in range(max(start + 1, end - overlap), end) if text[i] == "\n"]
        start = after[0] if after else max(start + 1, end - overlap)
    return found


def test_transcript_pieces(spark):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randrange(200)))
        cuts = whole_transcript(text, 40, 8)
        assert not text or (cuts[0][0] == 0 and cuts[-1][1] == len(text))
        assert all(b - a <= 40 for a, b in cuts)
        assert all(c <= b + 1 for (_, b), (c, _) in zip(cuts, cuts[1:]))
        streamed, lines, held = documents.Transcript(40, 8), [], []
        for line in text.split("\n"):  # rows of one line or several
            held.append(line)
            if rng.random() < 0.6:
                lines.append("\n".join(held))
                held = []
        lines += ["\n".join(held)] if held else []
        got = [piece for line in lines for piece in streamed.add(line)] + list(streamed.rest())
        assert got == [text[a:b] for a, b in cuts]
    rows = spark.createDataFrame([("e", 2, "user", "there"), ("e", 1, "user", None), ("f", 1, None, "x")], "episode_id string, turn int, role string, text string")
    assert sorted((r.episode_id, r.content) for r in documents.episode_chunks(rows).collect()) == [("e", "user: \nuser: there"), ("f", ": x")]
    assert documents.episode_chunks(rows.limit(0)).count() == 0
    many = spark.createDataFrame([(i % 3 if i % 3 else None, i, "user", "x" * (i % 50) + "\ny") for i in range(300)], "episode_id int, turn int, role string, text string")
    want = set()
    for e in (None, 1, 2):
        text = "\n".join(f"user: {'x' * (i % 50)}\ny" for i in range(300) if (i % 3 or None) == e)
        cuts = whole_transcript(text, 120, 30)
        want |= {(e, k, len(cuts), text[a:b]) for k, (a, b) in enumerate(cuts)}
    assert {tuple(r) for r in documents.episode_chunks(many, max_chars=120, overlap=30).collect()} == want


def test_sections(spark):
    q = spark.createDataFrame([(1, "p", "cats and dogs"), (2, "p", "the"), (3, "none", "cats")], "qid int, profile_id string, text string")
    s = spark.createDataFrame([("p", "s1", "Pets", "a cat"), ("p", "s2", None, "cats and dogs"), ("p", "s3", "", None), ("o", "s4", "cats", "dogs")], "profile_id string, id string, title string, body string")
    got = documents.search_sections(q, s).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(1, "s2", 1.25), (1, "s1", 0.5)]


def test_second_round(spark):
    first = spark.createDataFrame([(1, f"a{i}", 1 - i / 10) for i in range(6)] + [(2, "z", 0.5)], "qid int, id string, score double")
    more = spark.createDataFrame([(1, "a1", 2.0), (1, "b1", 0.3), (1, "b1", 0.4), (1, "b2", 0.9), (1, "b3", 0.1)], "qid int, id string, score double")
    got = fusion.deepened(first, more, 6).orderBy("qid", "rank").collect()
    assert [r.id for r in got if r.qid == 1] == ["a0", "a1", "a2", "a3", "b2", "b1"]
    assert [r.id for r in got if r.qid == 2] == ["z"]


def test_gists(spark):
    rows = [(1, "a", 0.9, 1, "e", 30), (1, "b", 0.8, 2, None, 5), (1, "c", 0.7, 3, "e", 30), (1, "d", 0.6, 4, "f", 9)]
    df = spark.createDataFrame(rows, "qid int, id string, score double, rank int, episode_id string, tokens int")
    gists = spark.createDataFrame([("e", "g", 40), ("f", "h", 1)], "episode_id string, gist_id string, gist_tokens int")
    got = fusion.follow_gists(df, gists).orderBy("rank").collect()
    assert [(r.id, r.rank, r.score) for r in got] == [("g", 1, 0.9), ("b", 2, 0.8), ("d", 3, 0.6)]


def test_contextual_view(spark):
    def rows(slot, value, context, n):
        return [(f"{slot}{value}{context}{i}", slot, "at", value, f"{slot}{value}{context}{i}", f"c{i}", 1.0, DAY, DAY, None, context) for i in range(n)]

    data = rows("s1", "v", None, 4) + rows("s1", "w", "x", 4) + rows("s2", "v", None, 4) + rows("s2", "a", "x", 2) + rows("s2", "b", "x", 2) + rows("s3", "v", None, 4)
    kind = "id string, subject string, attribute string, value_key string, evidence_key string, context_id string, weight double, observed_at timestamp, valid_from timestamp, valid_to timestamp, applicability string"
    e = spark.createDataFrame(data, kind)
    asked = spark.createDataFrame([(s, "at", "x") for s in ("s1", "s2", "s3", "s4")], "subject string, attribute string, applicability string")
    got = beliefs.contextual_view(e, asked, F.lit(DAY + dt.timedelta(days=1)))
    want = {"s1": ("w", "contextual_override"), "s2": (None, None), "s3": ("v", "global_fallback"), "s4": (None, None)}
    assert {r.subject: (r.value_key, r.reason) for r in got.collect()} == want


def test_associations_and_synonyms(spark):
    rows = [("a", "n", 1, [1.0, 0.0]), ("b", "n", 2, [0.9, 0.1]), ("c", "n", 3, [1.0, 0.05]), ("d", "o", 1, [1.0, 0.0]), ("e", "n", 4, None)]
    df = spark.createDataFrame(rows, "id string, namespace_id string, created_at int, embedding array<double>")
    got = retrieval.associations(df, df)
    assert sorted((r.qid, r.id) for r in got.collect()) == [("b", "a"), ("c", "a"), ("c", "b")]
    assert {r.qid: r.id for r in retrieval.synonyms(df, df).collect()} == {"a": "c", "b": "c", "c": "a"}


def test_query_map(spark):
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(30, 6)), rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(q, m))], "id int, query array<double>, memory array<double>")
    w = vectors.fit_query_map(df, 0.5)
    assert np.allclose(w, np.linalg.solve(q.T @ q + 0.5 * np.eye(6), q.T @ (m - q)))  # the primal form of the same ridge
    moved = vectors.map_queries(spark.createDataFrame([(1, q[0].tolist()), (2, None)], "id int, embedding array<double>"), w).orderBy("id").collect()
    want = q[0] + q[0] @ w
    assert np.allclose(moved[0].embedding, want / np.linalg.norm(want)) and moved[1].embedding is None


def test_hashed_embedding(spark):
    def fnv(word):
        h = 2166136261
        for c in word:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return h

    df = spark.createDataFrame([("a", "Red red blue"), ("b", ""), ("c", None)], "id string, content string")
    got = {r.id: np.array(r.embedding) for r in vectors.hashed_embedding(df, dims=16).collect()}
    want = np.zeros(16)
    for w in ("red", "red", "blue"):
        want[fnv(w) % 16] += -1 if fnv(w) >> 31 else 1
    assert np.allclose(got["a"], want / np.linalg.norm(want))
    assert got["b"][0] == got["c"][0] == 1 and not got["b"][1:].any()


def test_pagerank(spark):
    """Against a dense matrix, with a node that nothing leaves from."""
    links = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0), ("c", "b", 3.0), ("a", "d", 2.0)]
    names, seed = "abcd", np.array([0.25, 0.0, 0.0, 0.75])
    w = np.zeros((4, 4))
    for a, b, x in links:
        w[names.index(a), names.index(b)] = x
    p = seed
    for _ in range(15):
        out = w.sum(1, keepdims=True)
        moved = p @ np.divide(w, out, out=np.zeros_like(w), where=out > 0)
        p = 0.5 * seed + 0.5 * (moved + p[out[:, 0] == 0].sum() * seed)
    start = spark.createDataFrame([(1, "a", 1.0), (1, "d", 3.0)], "qid int, id string, mass double")
    got = {r.id: r.score for r in graph.pagerank(start, spark.createDataFrame(links, "a string, b string, w double")).collect()}
    assert np.allclose([got.get(n, 0.0) for n in names], p)


def dense(rows, seeds, rounds=15):
    """Scores above 0 of (qid, id) by a dense matrix over (a, b, w)."""
    names = sorted({r.a for r in rows} | {r.b for r in rows} | {i for of in seeds.values() for i in of})
    at = {n: k for k, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in rows:
        w[at[r.a], at[r.b]] = r.w
    out = w.sum(1, keepdims=True)
    move = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    found = {}
    for q, of in seeds.items():
        seed = np.zeros(len(names))
        for i, mass in of.items():
            seed[at[i]] += mass / sum(of.values())
        p = seed
        for _ in range(rounds):
            p = 0.5 * seed + 0.5 * (p @ move + p[out[:, 0] == 0].sum() * seed)
        found |= {(q, n): p[at[n]] for n in names if p[at[n]] > 0}
    return found


def test_registered_walks(spark, sf_dir, monkeypatch):
    """The entity graph's query and the flagship's graph lane take the operator's 15 rounds."""
    from lorekeep.plans import registry, search, search_queries  # noqa: F401  (the registry loads the queries)
    from lorekeep.sources.views import load

    edges, mentions = load(spark, sf_dir, "edges"), load(spark, sf_dir, "mentions")
    q, memories = search_queries.queries_of(spark, sf_dir), load(spark, sf_dir, "memories")
    want = dense(graph.entity_edges(edges, mentions).collect(), {r.qid: {r.qid: 1.0} for r in q.collect()})
    want = {k: v for k, v in want.items() if not k[1].startswith("e")}
    got = {(r.qid, r.id): r.score for r in search_queries.graph_entity_pagerank(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)

    given = []
    monkeypatch.setattr(search.graph, "pagerank", lambda seeds, walk, *a, real=graph.pagerank, **k: given.append((seeds, walk)) or real(seeds, walk, *a, **k))
    lane = search.lanes_of(q, memories, edges, 10_000)["graph"].collect()
    seeds = {}
    for r in given[0][0].collect():
        seeds.setdefault(r.qid, {})[r.id] = r.mass
    want = dense(given[0][1].collect(), seeds)
    assert {(r.qid, r.id) for r in lane} <= want.keys() and lane
    assert all(abs(r.score - want[r.qid, r.id]) < 1e-8 for r in lane)


def test_chains(spark):
    m = spark.createDataFrame([(i, "S", "job", None, DAY + dt.timedelta(days=n), None) for n, i in enumerate("cabd")] + [("x", "S", "pet", None, DAY, None), ("y", "T", "job", None, DAY, DAY)], "id string, subject string, attribute string, event_date timestamp, created_at timestamp, valid_to timestamp")
    e = spark.createDataFrame([("b", "a", "updates"), ("c", "b", "updates"), ("a", "c", "updates"), ("x", "a", "updates"), ("d", "a", "part_of")], "src string, dst string, relation string")
    hits = spark.createDataFrame([(1, "a"), (2, "d"), (3, "y")], "qid int, id string")
    assert {r.qid: r.ids for r in graph.chains(hits, m, e).collect()} == {1: ["c", "a", "b"], 3: ["y"]}


def test_recent_summary(spark):
    rows = [("n", str(i), DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=10 - i), i % 2, False) for i in range(6)] + [("o", "9", DAY, DAY, 0, False), ("o", "10", DAY, DAY, 1, True)]
    df = spark.createDataFrame(rows, "namespace_id string, id string, created_at timestamp, last_accessed_at timestamp, access_count int, forgotten boolean")
    got = {r.namespace_id: r for r in analytics.recent_summary(df, F.lit(DAY + dt.timedelta(days=4))).collect()}
    assert (got["n"].total, got["n"].remembered, got["n"].recalled, got["n"].latest, got["n"].latest_recalled) == (6, 2, 3, ["5", "4", "3"], ["1", "3", "5"])
    assert (got["o"].total, got["o"].latest, got["o"].latest_recalled) == (1, ["9"], None)
