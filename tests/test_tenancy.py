"""Merges with several losers and chains, invalidation, document search, and the facade with two tenants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep.api import Engine
from lorekeep.operators import documents, lifecycle

DAY = dt.datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_roots_of_merges(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("w", "y"), ("p", "q"), ("q", "p"), ("r", "q"), ("s", "s"), ("b", "a")] + [(f"k{i:02d}", f"k{i + 1:02d}") for i in range(40)]
    got = dict(rows(lifecycle.merge_roots(spark.createDataFrame(pairs, "winner string, loser string"))))
    want = {"a": "d", "b": "d", "c": "d", "y": "w", "q": "p"} | {f"k{i:02d}": "k00" for i in range(1, 41)}
    assert got == want


def test_merges_give_one_row_each(spark):
    make = spark.createDataFrame
    memories = make([("a", "one", False), ("b", "two", False), ("c", "three\n", False), ("d", "two", False), ("e", "alone", True), ("f", None, False), ("g", "old", False)], "id string, content string, forgotten boolean")
    edges = make([("b", "x", "part_of", 0.2), ("c", "x", "part_of", 0.7), ("b", "c", "part_of", 0.9), ("e", "d", "updates", 0.3)], "src string, dst string, relation string, weight double")
    mentions = make([("b", "p"), ("d", "p"), ("a", "p"), ("e", "q")], "memory_id string, entity_id string")
    # a wins over b and f, b over c, d over nothing but loses to c: all of them are a in the end; e has one loser by one pair
    pairs = make([("a", "b", "?"), ("a", "f", "?"), ("b", "c", "?"), ("c", "d", "?"), ("e", "g", "alone, and old")], "winner string, loser string, content string")
    got = lifecycle.merged(memories, edges, mentions, pairs)
    assert rows(got["memories"]) == [("a", "one\n\ntwo\n\nthree", False), ("b", "two", True), ("c", "three\n", True), ("d", "two", True), ("e", "alone, and old", True), ("f", None, True), ("g", "old", True)]
    assert rows(got["edges"]) == sorted([("a", "x", "part_of", 0.7), ("e", "a", "updates", 0.3), ("a", "b", "updates", 1.0), ("a", "c", "updates", 1.0), ("a", "d", "updates", 1.0), ("a", "f", "updates", 1.0), ("e", "g", "updates", 1.0)], key=repr)
    assert rows(got["mentions"]) == [("a", "p"), ("e", "q")]


@pytest.fixture
def engine(spark):
    make = spark.createDataFrame
    memories = make([("m1", "a", "old", None), ("m2", "a", "new", None), ("m3", "b", "theirs", None), ("m4", "b", "more", DAY)], "id string, namespace_id string, content string, valid_to timestamp").withColumn("forgotten", F.lit(False))
    edges = make([("m3", "m4", "part_of", 0.5)], "src string, dst string, relation string, weight double")
    return Engine(spark, {"memories": memories, "edges": edges, "mentions": make([], "memory_id string, entity_id string")})


def test_an_engine_of_one_tenant_links_its_own_rows(spark, engine):
    mine = engine.for_namespace("a")
    new = spark.createDataFrame([("m1", "m2", "related_to", 0.4), ("m1", "m3", "related_to", 0.4), ("m3", "m4", "part_of", 0.9)], "src string, dst string, relation string, weight double")
    assert rows(mine.link(new)) == [("m1", "m2", "related_to", 0.4), ("m3", "m4", "part_of", 0.5)]
    assert len(rows(engine.link(new))) == 3
    pairs = spark.createDataFrame([("m1", "m2"), ("m3", "m4"), ("m2", "m3")], "a string, b string")
    assert [r[:2] for r in rows(mine.reinforce(pairs))] == [("m1", "m2")]
    log = spark.createDataFrame([("m1", 1, DAY), ("m3", 2, DAY)], "memory_id string, id int, created_at timestamp")
    assert mine.history(log, "m3").collect() == [] and len(mine.history(log, "m1").collect()) == len(engine.history(log, "m3").collect()) == 1


def test_ends_of_rows_have_a_successor_and_a_history(spark, engine):
    ends = spark.createDataFrame([("m1", "m2"), ("m1", "m9"), ("m3", "m4"), ("m2", "m2"), (None, "m1")], "id string, successor string")
    got = engine.for_namespace("a").end(ends, F.lit(DAY))
    assert rows(got["memories"].select("id", "valid_to", "superseded_by")) == [("m1", DAY, "m2"), ("m2", DAY, None), ("m3", None, None), ("m4", DAY, None)]
    assert rows(got["edges"]) == [("m2", "m1", "updates", 1.0), ("m3", "m4", "part_of", 0.5)]
    assert rows(got["history"].select("memory_id", "event", "old_value", "new_value")) == [("m1", "INVALIDATE", None, "2024-03-01 00:00:00"), ("m2", "INVALIDATE", None, "2024-03-01 00:00:00")]
    # a row that ended before stays so; a successor of another tenant is none
    theirs = engine.for_namespace("b").end(spark.createDataFrame([("m4", "m1")], "id string, successor string"), F.lit(DAY + dt.timedelta(days=1)))
    assert rows(theirs["memories"].where("id = 'm4'").select("valid_to", "superseded_by")) == [(DAY, None)] and theirs["edges"].count() == 1


@pytest.fixture(scope="module")
def passages(spark):
    """Two tenants; source s of tenant a has two versions, the first of which is the better match."""
    chunk = lambda doc, space, k, text, v: (doc, space, k, text, v)
    found = [chunk("d1", "a", k, t, [1.0, 0.0]) for k, t in enumerate(["red fox", "red fox runs", "the end"])]
    found += [chunk("d2", "a", k, t, [0.0, 1.0]) for k, t in enumerate(["a blue fox", "walks", "home"])] + [chunk("d3", "b", 0, "red fox", [1.0, 0.0]), chunk("d4", "a", 0, "another red thing", None)]
    versions = [("d1", "a", "s", 1), ("d2", "a", "s", 2), ("d3", "b", "s", 3), ("d4", "a", "t", 1)]
    return spark.createDataFrame(found, "document_id string, namespace_id string, chunk_index long, content string, embedding array<double>"), spark.createDataFrame(versions, "document_id string, namespace_id string, source_key string, updated_at long")


def test_document_search_has_two_lanes_a_scope_and_a_fence(spark, passages):
    chunks, versions = passages
    q = spark.createDataFrame([(1, "red fox", [1.0, 0.0])], "qid int, text string, embedding array<double>")
    everything = documents.search_documents(q, chunks, 20, 0).collect()
    assert {r.document_id for r in everything} == {"d1", "d2", "d3", "d4"} and max(r.score for r in everything) == 1
    mine = documents.search_documents(q, chunks, 20, 0, scope={"namespace_id": "a"})
    assert {r.document_id for r in mine.collect()} == {"d1", "d2", "d4"}
    words = documents.search_documents(q.drop("embedding"), chunks, 20, 0, scope={"namespace_id": "a"}).collect()
    assert ("d2", 1) not in {(r.document_id, r.hit_index) for r in words} and ("d2", 1) in {(r.document_id, r.hit_index) for r in mine.collect()}
    # the old version is no result, and takes no place of one
    fenced = documents.search_documents(q, chunks, 2, 1, versions=versions, scope={"namespace_id": "a"}).collect()
    assert {(r.document_id, r.hit_index) for r in fenced} == {("d2", 0), ("d4", 0)} and {(r.document_id, r.chunk_index) for r in fenced} == {("d2", 0), ("d2", 1), ("d4", 0)}
    assert all(r.score < 1 for r in fenced)


def test_document_search_of_a_tenant(spark, passages):
    chunks, versions = passages
    mine = Engine(spark, {}).for_namespace("b")
    q = spark.createDataFrame([(1, "red fox", [1.0, 0.0])], "qid int, text string, embedding array<double>")
    for table in (chunks, chunks.drop("namespace_id")):
        assert {r.document_id for r in mine.search_documents(q, table, versions=versions).collect()} == {"d3"}
    with pytest.raises(ValueError, match="scope"):
        mine.search_documents(q, chunks.drop("namespace_id"))
    docs = spark.createDataFrame([("a", "s", "text a", None, DAY), ("b", "s", "text b", None, DAY)], "namespace_id string, source_key string, content string, metadata string, updated_at timestamp")
    made, pieces = mine.ingest_documents(docs)
    assert [r.content for r in made.collect()] == ["text b"] and pieces.count() == 1


def test_updates_set_nulls_and_adds_make_rows(spark):
    from lorekeep.operators import journal

    base = spark.createDataFrame([("a", "x", 1.0, "n"), ("b", "y", 2.0, "n"), ("c", "z", 3.0, "n"), ("d", None, None, "n")], "id string, content string, importance double, namespace_id string")
    log = [
        ("a", 1, "update", None, 0.5, ["content", "importance"]), ("a", 2, "update", "late", None, None), ("a", 3, "update", "not set", 0.9, ["importance"]),
        ("b", 4, "delete", None, None, None), ("b", 5, "add", "again", None, None), ("new", 6, "add", "made", 0.1, None), ("new", 7, "update", None, None, ["importance"]),
        ("gone", 8, "add", "q", 1.0, None), ("gone", 9, "purge", None, None, None), ("c", 10, "update", None, None, ["content"]), ("none", 11, "update", "no row", None, None), (None, 12, "add", "no id", None, None),
    ]
    df = spark.createDataFrame(log, "id string, seq int, op string, content string, importance double, sets array<string>")
    got = journal.fold(base, df, ["content", "importance"])
    assert rows(got) == sorted([("a", "late", 0.9, "n"), ("b", "again", None, "n"), ("c", None, 3.0, "n"), ("d", None, None, "n"), ("new", "made", None, None)], key=repr)
    plain = journal.fold(base, df.where("seq = 2").drop("sets"), ["content", "importance"])
    assert rows(plain.where("id = 'a'")) == [("a", "late", 1.0, "n")]


def test_days_are_of_utc(spark):
    from lorekeep.operators import analytics

    df = spark.sql("select timestamp '2024-03-01 23:30:00Z' as created_at union all select timestamp '1969-12-31 23:59:59.999Z'")
    old = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Asia/Tokyo", "America/Lima"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert sorted(r.day for r in df.select(analytics.day()).collect()) == ["1969-12-31", "2024-03-01"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)
