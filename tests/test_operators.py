"""Small exact cases of operators, sources and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep.api import Engine
from lorekeep.functions import scalars as S
from lorekeep.functions import temporal
from lorekeep.operators import documents, evaluation, filters, fusion, journal, maintenance, retrieval, state
from lorekeep.sources import files
from lorekeep.streaming import streams


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "start", "end"), [
    ("on 2023-05-07 then", "2023-05-07", "2023-05-07"), ("7th of May, 2023", "2023-05-07", "2023-05-07"), ("May 7, 2023", "2023-05-07", "2023-05-07"),
    ("in Feb of 2024", "2024-02-01", "2024-02-29"), ("winter 2023", "2023-12-01", "2024-02-29"), ("summer of 2022", "2022-06-01", "2022-08-31"), ("since 1999", "1999-01-01", "1999-12-31"),
    ("in 2500", None, None), ("no date", None, None),
])
def test_date_range(spark, text, start, end):
    got = spark.createDataFrame([(text,)], "t string").select(temporal.date_range(F.col("t")).alias("r")).first()["r"]
    if start is None:
        assert got is None or got["from"] is None
    else:
        assert str(got["from"])[:10] == start and str(got["to"]) == f"{end} 23:59:59.999000"


def test_filter_logic(spark):
    rows = [("a", "fact", 0.5, None, '{"n": 3, "s": "x", "deep": {"k": true}}'), ("b", None, None, "pet", '{"n": "3"}'), ("c", "goal", 1.0, "job", None)]
    df = spark.createDataFrame(rows, "id string, memory_type string, importance double, attribute string, m string").withColumn("metadata", F.parse_json("m"))

    def ids(tree):
        filters.validate(tree)
        return {r.id for r in df.where(filters.compile_filter(tree)).collect()}

    c = lambda f, o, v=None: {"field": f, "op": o, "value": v}
    assert ids(c("attribute", "ne", "pet")) == {"c"}
    assert ids({"not": c("attribute", "eq", "pet")}) == {"a", "c"}
    assert ids(c("memory_type", "nin", ["fact"])) == {"c"}
    assert ids(c("importance", "exists", False)) == {"b"}
    assert ids(c("metadata.n", "eq", 3)) == {"a"} and ids(c("metadata.n", "eq", "3")) == {"b"}
    assert ids(c("metadata.deep.k", "eq", True)) == {"a"} and ids(c("metadata.n", "exists", False)) == {"c"}
    assert ids(c("metadata.n", "gt", 2)) == {"a"} and ids(c("metadata.s", "contains", "x")) == {"a"}
    assert ids({"or": [c("id", "eq", "a"), {"and": [c("importance", "gte", 1), c("attribute", "icontains", "JO")]}]}) == {"a", "c"}
    for bad in (c("importance", "contains", "x"), c("unknown", "eq", 1), c("id", "exists", 1), {"and": []}, c("id", "in", "x"), c("id", "eq", "x" * 2000)):
        with pytest.raises(filters.InvalidFilter):
            filters.validate(bad)


def test_chunks(spark):
    text = "标题。" + "word " * 500 + "\n\nNext part. " + "more text here. " * 200
    rows = documents.chunk_text(text)
    raw = text.encode()
    assert all(raw[a:b].decode() == t for _, a, b, t in rows) and all(len(t) <= 1600 for *_, t in rows)
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[-1][2] == len(raw)
    assert documents.chunk_text("  \n ") == [] and documents.chunk_text("short") == [(0, 0, 5, "short")]
    df = spark.createDataFrame([("d", text), ("e", None)], "document_id string, content string")
    assert documents.chunks(df).count() == len(rows)


def test_hashes(spark):
    def fnv(text):
        h = 2166136261
        for k in range(0, len(raw := text.encode("utf-16-be")), 2):
            h = (h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619 % (1 << 32)
        return f"{h:08x}"

    texts = ["", "a", "memory text", "標題😀"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fnv1a(F.col("t")).alias("h"), S.stable_uuid(F.col("t")).alias("u"), S.utf16_length(F.col("t")).alias("n")).collect()
    assert all(r.h == fnv(r.t) and len(r.u) == 36 and r.u[14] == "5" and r.u[19] in "89ab" and r.n == len(r.t.encode("utf-16-be")) // 2 for r in got)


def test_scores(spark):
    assert one(spark, S.token_f1(F.lit("the cat sat"), F.lit("the cat ran"))) == pytest.approx(2 / 3)
    assert one(spark, S.bleu1(F.lit("the the"), F.lit("the cat sat"))) == pytest.approx(0.5 * 2.718281828 ** (1 - 3 / 2))
    assert one(spark, S.round_half_up(F.lit(-2.5))) == -2 and one(spark, S.value_key(F.lit("  A \t b "))) == "a b"
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_state_islands(spark):
    rows = [(1, "Ann ", "Job", "Dev", 1, "m1"), (2, "ann", "job", " dev", 2, "m2"), (3, "ann", "job", "Lead", 5, "m3"), (4, "ann", "job", "dev", 9, "m4")]
    obs = spark.createDataFrame(rows, "seq long, subject string, attribute string, value string, valid_from long, source_id string")
    got = [tuple(r) for r in state.slots(obs).orderBy("valid_from").select("value", "valid_from", "valid_to", "sources").collect()]
    assert got == [("Dev", 1, 5, ["m1", "m2"]), ("Lead", 5, 9, ["m3"]), ("dev", 9, None, ["m4"])]
    assert state.as_of(state.slots(obs), F.lit(5)).first()["value"] == "Lead"


def test_fusion_and_cut(spark):
    a = spark.createDataFrame([("q", "x", 0.9, 1), ("q", "y", 0.5, 2)], "qid string, id string, score double, rank int")
    b = spark.createDataFrame([("q", "y", 3.0, 1), ("q", "z", 1.0, 2)], "qid string, id string, score double, rank int")
    got = {r.id: r.score for r in fusion.rrf({"a": a, "b": b}, {"a": 1.0, "b": 0.0}).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62), "z": 0.0}
    pool = spark.createDataFrame([("q", "a", 1.0, 1, [1.0, 0.0], ["cat"], 2, 5), ("q", "b", 0.99, 2, [1.0, 0.01], ["cat"], 2, 5), ("q", "c", 0.4, 3, [0.0, 1.0], ["dog"], 2, 5)], "qid string, id string, score double, rank int, embedding array<double>, hits array<string>, n_aspects int, tokens long")
    assert [r.id for r in fusion.select_coverage(pool, 2).orderBy("rank").collect()] == ["a", "c"]
    assert [r.id for r in fusion.select_coverage(pool, 3).orderBy("rank").collect()] == ["a", "c", "b"]
    assert [r.id for r in fusion.select_coverage(pool, 3, budget=6).orderBy("rank").collect()] == ["a"]
    points = spark.createDataFrame([("s", float(x), y) for x, y in [(1, 0), (2, 1), (3, 0), (4, 1), (4, 1)]], "source string, score double, label int")
    curve = [(r.x, r.y) for r in fusion.isotonic(points).orderBy("x").collect()]
    assert curve == [(1.0, 0.0), (2.0, 0.5), (4.0, 1.0)]
    ready = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in curve])
    assert [one(spark, fusion.calibrate(F.lit(v), ready)) for v in (0.0, 3.0, 9.0)] == [0.0, 0.75, 1.0]


def test_intents(spark):
    for text, want in (("When did she move?", "temporal"), ("Who is Ann?", "single_fact"), ("List all pets", "synthesis"), ("Why?", "multi_hop"), (" ", "multi_hop")):
        assert one(spark, retrieval.intent(F.lit(text))) == want


def test_merges(spark):
    assert one(spark, maintenance.merged_content(F.lit("a b "), F.lit("b"))) == "a b"
    assert one(spark, maintenance.merged_content(F.lit("a"), F.lit("b"))) == "a\n\nb"
    edges = spark.createDataFrame([("a", "b", "updates", 0.2), ("b", "c", "updates", 0.9), ("a", "c", "updates", 0.4)], "src string, dst string, relation string, weight double")
    got = {tuple(r) for r in maintenance.rewire(edges, spark.createDataFrame([("a", "b")], "winner string, loser string")).collect()}
    assert got == {("a", "c", "updates", 0.9)}


def test_evaluation_guards(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "item_id long") for x in ([1, 2], [2, 3]))
    assert {tuple(r) for r in evaluation.comparable(a, b).collect()} == {(1, "a"), (3, "b")}
    run = spark.createDataFrame([(1, False, True, False), (2, False, False, True)], "item_id long, failed_add boolean, judge_error boolean, failed boolean")
    assert {r.broken for r in evaluation.publishable(run).collect()} == {"judge_errors", "failure_rate"}
    gate = spark.createDataFrame([("x", 0.1, 0.0), ("y", 0.2, 0.1), ("z", -0.1, -0.2)], "d string, delta double, low double")
    assert evaluation.portfolio_gate(gate).first()["passes"]


def test_delete_limit(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    with pytest.raises(ValueError):
        journal.delete_all(rows, F.lit(True), most=5)
    assert journal.delete_all(rows, F.col("id") < "3", most=5).count() == 7


def test_snapshot_round_trip(spark, tmp_path):
    memories = spark.createDataFrame([("m1", "n", None), ("m2", "n", "m1")], "id string, namespace_id string, superseded_by string")
    edges = spark.createDataFrame([("m1", "m2")], "src string, dst string")
    files.export_namespace({"memories": memories, "associations": edges}, "n", str(tmp_path / "good"))
    back = files.import_namespace(spark, str(tmp_path / "good"))
    assert sorted(map(tuple, back["memories"].collect()), key=repr) == sorted(map(tuple, memories.collect()), key=repr)
    files.export_namespace({"memories": memories, "associations": spark.createDataFrame([("m1", "m9")], "src string, dst string")}, "n", str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="m9"):
        files.import_namespace(spark, str(tmp_path / "bad"))
    files.stage_and_swap(memories, str(tmp_path / "table"))
    files.stage_and_swap(memories.limit(1), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.md").write_text("hi")
    (tmp_path / "texts/b.bin").write_bytes(b"\x00")
    assert [r.content for r in files.text_documents(spark, str(tmp_path / "texts")).collect()] == ["hi"]


def test_streams(spark, tmp_path):
    rows = [(i, "w0", "success" if i % 2 else "failed", 10 * i, dt.datetime(2024, 1, 1 + i // 5, i % 24), f"k{i % 3}") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, workspace_id string, status string, latency_ms long, created_at timestamp, idempotency_key string").withColumn("namespace_id", F.lit("n"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.daily_usage(source).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert {r.day: r.requests for r in spark.table("daily").collect()} == {f"2024-01-0{d}": 5 for d in (1, 2, 3, 4)}
    q = streams.first_claims(source).writeStream.format("memory").queryName("claims").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("claims").count() == 3


def test_facade(spark, sf_dir):
    e = Engine.over(spark, sf_dir).for_namespace("ns0")
    assert e.count() == e.memories.where("not forgotten").count() and {r.namespace_id for r in e.get_all(limit=20).collect()} == {"ns0"}
    q = e.memories.where("id = 'm0000001'").select(F.col("id").alias("qid"), F.col("content").alias("text"), "embedding")
    found = e.search(q, limit=5, filter={"field": "importance", "op": "gte", "value": 0.2}).collect()
    allowed = {r.id for r in e.memories.where("importance >= 0.2 and not forgotten").collect()}
    assert 0 < len(found) <= 5 and {r.id for r in found} <= allowed and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    assert e.search(q, mode="recent", limit=3).count() == 3


def test_writes_keep_other_tenants(spark, sf_dir):
    """Every write in a namespace returns the rows of all, and changes none of the others."""
    whole = Engine.over(spark, sf_dir)
    e = whole.for_namespace("ns0")
    every = {r.id: r for r in whole.memories.select("id", "namespace_id", "valid_to", "importance", "content").collect()}
    other = {i for i, r in every.items() if r.namespace_id != "ns0"}
    at = F.lit(dt.datetime(2024, 2, 1))
    ids = whole.memories.select("id")
    ended = {r.id: r.valid_to for r in e.invalidate(ids, at).collect()}
    assert set(ended) == set(every) and all(ended[i] == every[i].valid_to for i in other) and all(ended[i] is not None for i in set(every) - other)
    aged = {r.id: r.importance for r in e.run_maintenance(F.lit(dt.datetime(2024, 6, 1))).collect()}
    assert other <= set(aged) and all(aged[i] == every[i].importance for i in other) and len(aged) < len(every)
    log = whole.memories.select("id", F.lit(1).alias("seq"), F.when(F.col("id") < "m0000100", "delete").otherwise("update").alias("op"), F.lit("new").alias("content"))
    after = {r.id: r.content for r in e.update(log, ["content"]).collect()}
    assert all(after[i] == every[i].content for i in other) and {i for i in set(every) - other if i in after} == {i for i in set(every) - other if i >= "m0000100"}
    left = e.delete(ids)
    assert {r.id for r in left["memories"].collect()} == other and {r.id for r in e.purge_namespace()["memories"].collect()} == other
    tiers = {r.id: r.tier for r in e.promote(ids, at).collect()}
    assert set(tiers) == set(every) and all((t == "working") == (i not in other) for i, t in tiers.items())
    near = {r.id for r in e.neighbours(e.memories.select("id"), 1).collect()}
    assert near and not near & other


def test_search_modes(spark, sf_dir):
    e = Engine.over(spark, sf_dir).for_namespace("ns0")
    q = e.memories.where("id < 'm0000006'").select(F.col("id").alias("qid"), F.when(F.col("id") == "m0000001", "who is there?").otherwise(F.col("content")).alias("text"), "embedding")
    mine = {r.id for r in e.memories.where("not forgotten").collect()}
    for mode in ("precision", "deep", "auto"):
        rows = e.search(q, limit=5, mode=mode).collect()
        assert rows and {r.id for r in rows} <= mine and all(1 <= r["rank"] <= 5 for r in rows)
    with pytest.raises(ValueError):
        e.search(q, mode="nonsense")
    with pytest.raises(ValueError):
        e.get_belief_view(F.lit(dt.datetime(2024, 2, 1)))
    assert e.get_state().count() <= Engine.over(spark, sf_dir).get_state().count()


@pytest.mark.parametrize(("value", "want"), [("2023", "2023-01-01"), ("2023-04", "2023-04-01"), ("2023-04-05", "2023-04-05"), ("2023-04-05T10:00:00Z", "2023-04-05"), ("soon", None), ("2023-13", None), (None, None)])
def test_event_date(spark, value, want):
    got = spark.createDataFrame([(value,)], "t string").select(temporal.event_date(F.col("t")).alias("d")).first()["d"]
    assert (got and str(got)[:10]) == want


def test_chunk_ends(spark):
    """A chunk ends before an ideographic full stop, after a full stop, and never within a pair of surrogates."""
    han = documents.chunk_text("字" * 150 + "。" + "字" * 100, 200, 0)
    assert [len(t) for *_, t in han] == [150, 101] and han[1][3][0] == "。"
    dot = documents.chunk_text("a" * 150 + ". " + "b" * 100, 200, 0)
    assert [len(t) for *_, t in dot] == [151, 101]
    faces = documents.chunk_text("x" + "😀" * 300, 200, 10)
    raw = ("x" + "😀" * 300).encode()
    assert all(raw[a:b].decode() == t and len(t.encode("utf-16-le")) <= 400 for _, a, b, t in faces) and faces[-1][2] == len(raw)


def test_entry_without_optional_parts():
    """The entry module must import, and keep its queries, without the optional subpackage."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['lorekeep.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'search_hybrid' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 60
