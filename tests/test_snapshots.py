"""Stores of versions and snapshots of one namespace of two."""

import datetime as dt

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lorekeep.sources import files, snapshots
from lorekeep.sources.snapshots import Store, VersionConflict

NOON = dt.datetime(2024, 5, 1, 12, 0, 0, 250_000)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def two(spark):
    """Tables of tenants a and b; one edge goes from one to the other."""
    make = spark.createDataFrame
    return {
        "memories": make([("m1", "a", "e1", None, NOON), ("m2", "a", None, "m1", NOON), ("m3", "b", "e2", None, NOON), ("m4", "b", None, None, None), ("m0", None, None, None, None)], "id string, namespace_id string, episode_id string, superseded_by string, created_at timestamp"),
        "episodes": make([("e1", "a"), ("e2", "b")], "id string, namespace_id string"),
        "entities": make([("x", "a"), ("y", "b")], "id string, namespace_id string"),
        "edges": make([("m1", "m2", 0.5), ("m3", "m4", 0.25), ("m2", "m3", 0.1), ("m4", "m0", 0.1)], "src string, dst string, weight double"),
        "mentions": make([("m1", "x"), ("m3", "y"), ("m4", "x")], "memory_id string, entity_id string"),
        "history": make([("h1", "m2"), ("h2", "m3")], "id string, memory_id string"),
        "documents": make([("d1", "a", "s"), ("d2", "b", "s")], "id string, namespace_id string, source_key string"),
        "document_heads": make([("a", "s", "d1"), ("b", "s", "d2")], "namespace_id string, source_key string, document_id string"),
        "operations": make([("o1", "a", "add", ["m1"]), ("o2", "a", "delete_all", ["gone"]), ("o3", "b", "add", ["m3"])], "id string, namespace_id string, kind string, memory_ids array<string>"),
        "events": make([("v1", "a", "o1", "m1"), ("v2", "a", "o2", "gone"), ("v3", "a", "o2", "o2"), ("v4", "b", "o3", "m3")], "id string, namespace_id string, operation_id string, memory_id string"),
    }


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_a_snapshot_has_one_tenants_rows(spark, tmp_path, two, form):
    files.export_namespace(two, "a", str(tmp_path / "s"), form)
    back = files.import_namespace(spark, str(tmp_path / "s"))
    assert set(back) == set(two)
    assert rows(back["edges"]) == [("m1", "m2", 0.5)] and rows(back["mentions"]) == [("m1", "x")] and rows(back["history"]) == [("h1", "m2")]
    for name in ("memories", "episodes", "documents", "operations", "events", "document_heads", "entities"):
        assert rows(back[name].select(two[name].columns)) == rows(two[name].where("namespace_id = 'a'"))
        assert back[name].schema == two[name].schema
    if form == "json":
        text = "".join(p.read_text() for p in (tmp_path / "s").rglob("memories/part-*.json"))
        assert '"created_at":"2024-05-01T12:00:00.250000Z"' in text


def test_import_into_a_store_is_one_version_and_needs_an_empty_target(spark, tmp_path, two):
    files.export_namespace(two, "a", str(tmp_path / "a"))
    store = Store(spark, str(tmp_path / "store"))
    store.commit(snapshots.owned(two, "b"))
    before = {n: rows(df) for n, df in store.tables().items()}
    files.import_namespace(spark, str(tmp_path / "a"), store)
    assert store.versions() == [1, 2]
    after = store.tables()
    assert rows(after["memories"]) == rows(two["memories"].where("namespace_id is not null"))
    assert rows(snapshots.owned(after, "a")["edges"]) == [("m1", "m2", 0.5)] and after["edges"].count() == 2
    assert {n: rows(df) for n, df in store.tables(1).items()} == before
    with pytest.raises(ValueError, match="not empty"):
        files.import_namespace(spark, str(tmp_path / "a"), store)
    assert store.versions() == [1, 2]


@pytest.mark.parametrize("at", range(11))
def test_a_job_that_dies_between_writes_leaves_the_old_version(spark, tmp_path, two, at, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(two)
    before = {n: rows(df) for n, df in store.tables().items()}
    done = []

    def dies(real):
        def run(*a, **k):
            if len(done) == at:
                raise KeyboardInterrupt
            done.append(1)
            return real(*a, **k)

        return run

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", dies(DataFrameWriter.parquet))
        m.setattr(Store, "_publish", dies(Store._publish))
        with pytest.raises(KeyboardInterrupt):
            store.commit({n: df.limit(0) for n, df in two.items()})
    assert len(done) == at and store.versions() == [1]
    assert {n: rows(df) for n, df in Store(spark, str(tmp_path / "store")).tables().items()} == before


def test_two_writers_of_one_version(spark, tmp_path, two):
    store = Store(spark, str(tmp_path / "store"))
    assert store.commit({"memories": two["memories"]}, {"why": "first"}) == 1
    assert store.commit({"edges": two["edges"]}, base=1) == 2
    with pytest.raises(VersionConflict):
        store.commit({"edges": two["edges"].limit(0)}, base=1)
    assert store.versions() == [1, 2] and store.manifest(1)["why"] == "first"
    # a table that a version does not change is not written again
    assert store.manifest(2)["tables"]["memories"] == store.manifest(1)["tables"]["memories"] and store.tables()["edges"].count() == 4
    assert not [p.name for p in (tmp_path / "store/commits").iterdir() if p.suffix == "" and not p.name.endswith(".crc")]
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "nothing")).tables()


def test_faults(spark, two):
    def faults(**changed):
        return {(r.table, r.column, r.value) for r in snapshots.violations(snapshots.owned(two, "a") | changed, "a").collect()}

    make = spark.createDataFrame
    assert faults() == set()
    assert faults(edges=make([("m1", "m9")], "src string, dst string")) == {("edges", "dst", "m9")}
    assert faults(document_heads=make([("a", "other", "d1")], "namespace_id string, source_key string, document_id string")) == {("document_heads", "source_key", "other")}
    assert faults(episodes=make([("e1", "a"), ("e1", "a"), (" ", "a"), (None, "a"), ("e3", "z")], "id string, namespace_id string")) == {("episodes", "id", "e1"), ("episodes", "id", " "), ("episodes", "id", None), ("episodes", "namespace_id", "z")}
    assert faults(events=make([("v1", "a", "o1", "m7")], "id string, namespace_id string, operation_id string, memory_id string")) == {("events", "memory_id", "m7")}
    assert faults(operations=make([("o1", "a", "add", ["m8"]), ("o2", "a", "delete_all", ["gone"])], "id string, namespace_id string, kind string, memory_ids array<string>")) == {("operations", "memory_ids", "m8")}


def test_a_table_without_an_owner_is_an_error(spark, two):
    with pytest.raises(ValueError, match="loose"):
        snapshots.owned(two | {"loose": spark.createDataFrame([("m1",)], "name string")}, "a")


def test_a_swap_that_dies_can_be_taken_back(spark, tmp_path):
    path = str(tmp_path / "t")
    files.stage_and_swap(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / f"t{files.ASIDE}")  # where a job between the two renames leaves it
    assert spark.read.parquet(files.recovered(spark, path)).count() == 3
    (tmp_path / "t").rename(tmp_path / f"t{files.ASIDE}")
    files.stage_and_swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / f"t{files.ASIDE}").exists()


def test_files_that_are_not_read_are_listed(spark, tmp_path):
    (tmp_path / "a.md").write_text("hi")
    (tmp_path / "b.bin").write_bytes(b"\0")
    (tmp_path / "c.txt").write_text("long " * 10)
    assert [r.content for r in files.text_documents(spark, str(tmp_path), 20).collect()] == ["hi"]
    got = files.left_out(spark, str(tmp_path), 20).select(F.element_at(F.split("source_key", "/"), -1), "length", "reason")
    assert rows(got) == [("b.bin", 1, "media"), ("c.txt", 50, "size")]
