"""Versioned table stores and snapshots of a namespace.

A store is a folder. Each version has its tables' files under names of their own and a manifest that lists them; the manifest is put in
place last, by one rename that fails if the version is there already. So a version is all of its tables or none of them: a job that dies
between two writes leaves the version before it as it was, and of two writers that start from one version the second gets an error."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT, VERSION = "memory-snapshot", 1
#: References of a snapshot: (table, column, target table, target column); a null is no reference.
REFERENCES = (
    ("document_heads", "document_id", "documents", "id"), ("document_chunks", "document_id", "documents", "id"),
    ("associations", "src", "memories", "id"), ("associations", "dst", "memories", "id"), ("edges", "src", "memories", "id"), ("edges", "dst", "memories", "id"),
    ("history", "memory_id", "memories", "id"), ("mentions", "memory_id", "memories", "id"), ("mentions", "entity_id", "entities", "id"),
    ("memories", "episode_id", "episodes", "id"), ("memories", "superseded_by", "memories", "id"), ("events", "operation_id", "operations", "id"),
)
#: Tables whose rows may name memories that were purged: their ids live on in the journal.
JOURNAL = {("events", "memory_id"), ("operations", "memory_ids")}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


class VersionConflict(RuntimeError):
    """Another writer has committed the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        """The versions that are there, oldest first."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """What a version (None: the last) says: tables, with their path, form and schema, and its notes."""
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"{self.root} has no version {'' if version is None else version}".rstrip())
        name = self._path("commits", f"{found[-1] if version is None else version:020d}.json")
        stream = self._fs.open(name)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of one version."""
        out = {}
        for name, about in self.manifest(version)["tables"].items():
            reader = self.spark.read.schema(StructType.fromJson(about["schema"]))
            path = f"{self.root}/{about['path']}"
            out[name] = reader.parquet(path) if about["form"] == "parquet" else reader.option("mode", "FAILFAST").option("timestampFormat", ISO).option("timeZone", "UTC").json(path)
        return out

    def commit(self, changed: dict[str, DataFrame], notes: dict[str, Any] | None = None, form: str = "parquet", base: int | None = None, keep: bool = True) -> int:
        """Writes the changed tables and then the manifest of the next version, in which the other tables are those of ``base`` (the last
        version by default; ``keep`` false: there are no others). Returns its number."""
        last = self.versions()
        base = (last[-1] if last else 0) if base is None else base
        tables = dict(self.manifest(base)["tables"]) if keep and base else {}
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in changed.items():
            ordered = df.sortWithinPartitions(*[c for c in ("id",) if c in df.columns] or df.columns[:1])
            writer, path = ordered.write, f"{folder}/{name}"
            if form == "parquet":
                writer.parquet(f"{self.root}/{path}")
            else:
                writer.option("timestampFormat", ISO).option("timeZone", "UTC").option("ignoreNullFields", True).json(f"{self.root}/{path}")
            tables[name] = {"path": path, "form": form, "schema": json.loads(df.schema.json())}
        return self._publish(base + 1, {"tables": tables, "written_at": datetime.now(UTC).isoformat(), **(notes or {})})

    def _publish(self, version: int, manifest: dict[str, Any]) -> int:
        staged, final = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", f"{version:020d}.json")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(staged.toUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(staged, final, no_overwrite)
        except Exception as e:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                raise VersionConflict(f"{self.root} has a version {version} of another writer") from e
            raise
        return version


def owned(tables: dict[str, DataFrame], namespace: str) -> dict[str, DataFrame]:
    """Each table's rows of one namespace. A table with ``namespace_id`` is filtered by it; of another one those rows stay that refer to a row
    of the namespace and to no row of another one. A reference to a row that is nowhere stays, to be found by ``violations``."""
    out = {}
    for name, df in tables.items():
        if "namespace_id" in df.columns:
            out[name] = df.where(F.col("namespace_id") == namespace)
            continue
        refs = [(c, t, k) for n, c, t, k in REFERENCES if n == name and t in tables and c in df.columns and "namespace_id" in tables[t].columns]
        if not refs:
            raise ValueError(f"{name} has neither namespace_id nor a reference to a table that has one")
        marks: list[Column] = []
        for i, (column, target, key) in enumerate(refs):
            # 1: of the namespace, -1: of another one, null: nowhere
            whose = tables[target].groupBy(F.col(key).alias(f"__key{i}")).agg(F.max(F.when(F.col("namespace_id").eqNullSafe(F.lit(namespace)), 1).otherwise(-1)).alias(f"__mark{i}"))
            df = df.join(whose, F.col(column) == F.col(f"__key{i}"), "left").drop(f"__key{i}")
            marks.append(F.coalesce(f"__mark{i}", F.lit(0)))
        mine = reduce(lambda a, b: a | b, [m == 1 for m in marks]) & ~reduce(lambda a, b: a | b, [m == -1 for m in marks])
        out[name] = df.where(mine).drop(*[f"__mark{i}" for i in range(len(refs))])
    return out


def violations(tables: dict[str, DataFrame], namespace: str | None = None) -> DataFrame:
    """A row per fault: table, column, value. Faults are dangling references, rows of another namespace, ids that are null, blank or
    repeated, heads whose source is not their document's, and journal rows that name memories which neither are there nor were purged."""
    found = []
    fault = lambda df, name, column, value: df.select(F.lit(name).alias("table"), F.lit(column).alias("column"), value.cast("string").alias("value"))
    for name, column, target, key in REFERENCES:
        if name in tables and target in tables and column in tables[name].columns:
            refs = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
            found.append(fault(refs.join(tables[target].select(F.col(key).alias("value")), "value", "left_anti"), name, column, F.col("value")))
    for name, df in tables.items():
        if namespace is not None and "namespace_id" in df.columns:
            found.append(fault(df.where(~F.col("namespace_id").eqNullSafe(F.lit(namespace))), name, "namespace_id", F.col("namespace_id")))
        if "id" in df.columns:
            found.append(fault(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null or trim(cast(id as string)) = ''"), name, "id", F.col("id")))
    heads, documents = tables.get("document_heads"), tables.get("documents")
    if heads is not None and documents is not None and "source_key" in heads.columns and "source_key" in documents.columns:
        told = heads.join(documents.select(F.col("id").alias("document_id"), F.col("source_key").alias("__key")), "document_id")
        found.append(fault(told.where(~F.col("source_key").eqNullSafe(F.col("__key"))), "document_heads", "source_key", F.col("source_key")))
    if "memories" in tables and "operations" in tables:
        known = _journal_ids(tables)
        for name, column in sorted(JOURNAL):
            if name in tables and column in tables[name].columns:
                ids = tables[name].select(*([F.explode(column).alias("id")] if name == "operations" else [F.col(column).alias("id")])).where("id is not null").distinct()
                found.append(fault(ids.join(known, "id", "left_anti"), name, column, F.col("id")))
    spark = next(iter(tables.values())).sparkSession
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "table string, column string, value string")


def _journal_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that a journal may name: memories, those that a purge, an import or a bulk delete has removed, and bulk deletes themselves."""
    operations, ids = tables["operations"], [tables["memories"].select("id")]
    if {"kind", "memory_ids"} <= set(operations.columns):
        ids.append(operations.where(F.col("kind").isin("purge", "delete_all", "import")).select(F.explode("memory_ids").alias("id")))
    if {"kind", "id"} <= set(operations.columns):
        ids.append(operations.where("kind = 'delete_all'").select("id"))
    return reduce(DataFrame.union, ids).distinct()


def export_namespace(tables: dict[str, DataFrame], namespace: str, path: str, form: str = "parquet") -> int:
    """A snapshot of one namespace as the next version of the store at ``path``: its own rows alone (see ``owned``), in order of id; as Parquet or
    as JSON with ISO times in UTC. Projections (vectors, slots, beliefs) are rebuilt after an import and not part of it."""
    spark = next(iter(tables.values())).sparkSession
    notes = {"format": FORMAT, "version": VERSION, "source_namespace": namespace, "projections": "rebuild-required"}
    return Store(spark, path).commit(owned(tables, namespace), notes, form, keep=False)


def import_namespace(spark: SparkSession, path: str, into: Store | None = None) -> dict[str, DataFrame]:
    """Reads a snapshot's last version and checks its header and ``violations``; nothing is returned of one that fails. into: a store whose tables
    hold no row of the namespace, and which gets all tables' rows in one version."""
    header = Store(spark, path).manifest()
    if header.get("format") != FORMAT or header.get("version") != VERSION:
        raise ValueError("not a snapshot of this format and version")
    namespace, tables = header["source_namespace"], Store(spark, path).tables()
    bad = violations(tables, namespace).limit(5).collect()
    if bad:
        raise ValueError(f"snapshot is not consistent: {[tuple(r) for r in bad]}")
    if into is not None:
        there = into.versions()
        base = there[-1] if there else 0
        held = into.tables(base) if base else {}
        taken = [n for n, rows in owned(held, namespace).items() if rows.take(1)]
        if taken:
            raise ValueError(f"{sorted(taken)} of {namespace} are not empty")
        into.commit({n: held[n].unionByName(df, allowMissingColumns=True) if n in held else df for n, df in tables.items()}, {"imported": namespace}, base=base)
    return tables
