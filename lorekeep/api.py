"""The engine's facade: a set of tables and the operations on them, each a DataFrame.

Reads return DataFrames of the scope. Writes change rows of the scope, and return the new state of a whole table, other tenants' rows
included, as a DataFrame; nothing is changed in place, the caller stores it (see ``sources.files.stage_and_swap``)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics, beliefs, documents, filters, graph, journal, lifecycle, listing, maintenance, retrieval, state
from .plans import search as plans
from .sources import views


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    tables: dict[str, DataFrame]
    scope: dict[str, str] = field(default_factory=dict)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Engine:
        """The engine over the views of a folder of raw tables."""
        return cls(spark, {n: views.load(spark, sf_dir, n) for n in views._VIEWS})

    def for_namespace(self, namespace_id: str) -> Engine:
        """The same engine, every read of which is in the namespace: filters are AND-ed and can't widen it."""
        return replace(self, scope=self.scope | {"namespace_id": namespace_id})

    @property
    def memories(self) -> DataFrame:
        return self.tables["memories"].where(filters.scope_wildcard(**self.scope))

    def _where(self, filter: dict | None, structural: dict[str, Any]) -> Column:
        test = filters.structural(**structural) if structural else F.lit(True)
        if filter is not None:
            filters.validate(filter)
            test = test & filters.compile_filter(filter)
        return test

    def get(self, id_: str) -> DataFrame:
        return listing.get(self.memories, id_)

    def get_all(self, sort: str = "recent", limit: int = 100, offset: int = 0, cursor: str | None = None, filter: dict | None = None, **structural: Any) -> DataFrame:
        return listing.listed(self.memories, self._where(filter, structural), sort, cursor, offset, limit)

    def count(self, filter: dict | None = None, **structural: Any) -> int:
        return self.memories.where(filters.visible() & self._where(filter, structural)).count()

    def search(self, queries: DataFrame, limit: int = 10, mode: str = "hybrid", filter: dict | None = None, weights: dict[str, float] | None = None, min_score: float = 0.0, budget: int = 0, **structural: Any) -> DataFrame:
        """queries: qid and any of text, embedding, from, to. Modes: hybrid; precision (single facts); deep (a lexical second round after the
        vectors); auto, which sends each query to precision or hybrid by what it asks for; recent, important and typed need no queries."""
        where = self._where(filter, structural)
        if mode in ("recent", "important", "typed"):
            return plans.metadata_search(self.memories, "recent" if mode == "recent" else "importance", limit, where=where)
        rows = self.memories.where(where)
        if mode == "precision":
            return plans.precision(queries, rows, limit)
        if mode == "deep":
            return plans.deep(queries, rows, limit)
        if mode == "auto":
            told = queries.withColumn("__strategy", retrieval.strategy(retrieval.intent(F.col("text"))))
            exact, wide = (told.where(test).drop("__strategy") for test in ("__strategy = 'precision'", "__strategy <> 'precision'"))
            found = plans.hybrid(wide, self.memories, self.tables.get("edges"), limit, weights, min_score=min_score, where=where, budget=budget)
            return plans.precision(exact, rows, limit).select("qid", "id", "score", F.col("rank").cast("long").alias("rank")).unionByName(found.select("qid", "id", "score", "rank"))
        if mode != "hybrid":
            raise ValueError(f"there is no search mode {mode}")
        return plans.hybrid(queries, self.memories, self.tables.get("edges"), limit, weights, min_score=min_score, where=where, budget=budget)

    def add(self, messages: DataFrame) -> DataFrame:
        return journal.add_verbatim(messages)

    def update(self, log: DataFrame, columns: list[str]) -> DataFrame:
        """The memories of all tenants after a log of updates, deletes and purges, of which only those of rows in scope count."""
        mine = self.memories.select("id")
        return journal.fold(self.tables["memories"], log.join(mine, "id", "left_semi"), columns)

    def delete(self, ids: DataFrame) -> dict[str, DataFrame]:
        """memories, edges and mentions of all tenants without the given rows of this scope and their links."""
        mine = self.memories.join(ids.select("id"), "id", "left_semi")
        return lifecycle.without(self.tables["memories"], self.tables["edges"], self.tables["mentions"], mine)

    def purge_namespace(self) -> dict[str, DataFrame]:
        return lifecycle.purged(self.tables["memories"], self.tables["edges"], self.tables["mentions"], self.scope["namespace_id"])

    def delete_all(self) -> DataFrame:
        return journal.delete_all(self.tables["memories"], filters.scope_wildcard(**self.scope))

    def invalidate(self, ids: DataFrame, at: Column) -> DataFrame:
        """The memories of all tenants; those in scope of the given ids have valid_to set, if they don't end before."""
        hits = self.memories.join(ids.select("id"), "id", "left_semi").select("id", F.lit(True).alias("__hit"))
        rows = self.tables["memories"].join(hits, "id", "left")
        return rows.withColumn("valid_to", F.when(F.col("__hit"), F.least(F.coalesce("valid_to", at), at)).otherwise(F.col("valid_to"))).drop("__hit")

    def end(self, ends: DataFrame, at: Column) -> dict[str, DataFrame]:
        """memories and edges of all tenants and new history rows, after rows of this scope (id, successor or null) came to an end; a successor out
        of scope counts as null."""
        mine = self.memories.select("id")
        inner = ends.join(mine, "id", "left_semi").join(mine.select(F.col("id").alias("successor"), F.lit(True).alias("__in")), "successor", "left")
        inner = inner.select("id", F.when(F.col("__in"), F.col("successor")).alias("successor"))
        return lifecycle.invalidated(self.tables["memories"], self.tables["edges"], inner, at)

    def promote(self, ids: DataFrame, now: Column) -> DataFrame:
        return lifecycle.promoted(self.tables["memories"], self.memories.join(ids.select("id"), "id", "left_semi"), now)

    @property
    def edges(self) -> DataFrame:
        """The edges both of whose ends are in scope."""
        return self._inside(self.tables["edges"])

    def neighbours(self, ids: DataFrame, depth: int = 1) -> DataFrame:
        return graph.neighbours(ids, self.edges, depth)

    def graph(self, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        return listing.subgraph(self.memories, self.tables["edges"], limit)

    def link(self, edges: DataFrame) -> DataFrame:
        """Edges of all tenants after an upsert of those whose both ends are in scope: the last weight of each (src, dst, relation)."""
        edges = self._inside(edges)
        both = self.tables["edges"].select("src", "dst", "relation", "weight", F.lit(0).alias("n")).unionByName(edges.select("src", "dst", "relation", "weight", F.lit(1).alias("n")))
        return both.groupBy("src", "dst", "relation").agg(F.max_by("weight", "n").alias("weight"))

    def reinforce(self, pairs: DataFrame, eta: float = 0.1, cap: float = 0.95) -> DataFrame:
        """Of pairs (a, b) those whose both ends are in scope."""
        return maintenance.reinforce(self.tables["edges"], self._inside(pairs, *pairs.columns[:2]), eta, cap)

    def _inside(self, rows: DataFrame, one: str = "src", two: str = "dst") -> DataFrame:
        """Rows both of whose ends are in scope."""
        if not self.scope:
            return rows
        mine = self.memories.select("id")
        for end in (one, two):
            rows = rows.join(mine.withColumnRenamed("id", end), end, "left_semi")
        return rows

    def run_maintenance(self, now: Column) -> DataFrame:
        """The memories of all tenants after decay and pruning of those in scope; consolidation is ``maintenance.merge_pairs``."""
        mine = F.coalesce(filters.scope_wildcard(**self.scope), F.lit(False))
        aged = maintenance.decay(self.tables["memories"], now).withColumn("importance", F.when(mine, F.col("decayed")).otherwise(F.col("importance"))).drop("decayed", "written")
        return aged.where(~(mine & F.coalesce(maintenance.prunable(now), F.lit(False))))

    def _of_scope(self, name: str) -> DataFrame:
        """The rows of a table in scope: by its own scope columns, else by the memories that its rows come from."""
        rows = self.tables[name]
        by = {k: v for k, v in self.scope.items() if k in rows.columns}
        if len(by) == len(self.scope):
            return rows.where(filters.scope_wildcard(**by))
        if "source_id" not in rows.columns:
            raise ValueError(f"{name} can't be read in a scope: it has neither {sorted(set(self.scope) - set(by))} nor source_id")
        return rows.where(filters.scope_wildcard(**by)).join(self.memories.select(F.col("id").alias("source_id")), "source_id", "left_semi")

    def get_state(self, at: Column | None = None) -> DataFrame:
        rows = state.slots(self._of_scope("state_obs"))
        return state.current(rows) if at is None else state.as_of(rows, at)

    def get_state_history(self) -> DataFrame:
        return state.slots(self._of_scope("state_obs"))

    def belief_at(self, at: Column) -> DataFrame:
        return state.belief_at(self.memories.withColumn("valid_from", F.col("created_at")), at)

    def get_belief_view(self, at: Column, mode: str = "default", policy: beliefs.Policy = beliefs.Policy()) -> DataFrame:
        return beliefs.view(self._of_scope("evidence"), at, policy, mode)

    def list_scope_entities(self) -> DataFrame:
        return analytics.scope_entities(self.memories)

    def stats(self) -> DataFrame:
        return analytics.namespace_stats(self.memories)

    def history(self, log: DataFrame, memory_id: str) -> DataFrame:
        """A row's history, if the row is in scope."""
        return journal.history(log.join(self.memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi") if self.scope else log, memory_id)

    def ingest_documents(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(versions, chunks) of the documents in scope: namespace_id, source_key, content, metadata, updated_at."""
        docs = docs.where(self._scoped(docs))
        versions = documents.with_versions(docs)
        return versions, documents.chunks(versions)

    def _scoped(self, rows: DataFrame) -> Column:
        missing = set(self.scope) - set(rows.columns)
        if missing:
            raise ValueError(f"rows without {sorted(missing)} can't be told to be in scope")
        return filters.scope_wildcard(**self.scope)

    def search_documents(self, queries: DataFrame, chunk_rows: DataFrame, limit: int = 5, neighbors: int = 1, versions: DataFrame | None = None) -> DataFrame:
        """Passages in scope, of current versions where ``versions`` are given; passages have the scope's columns or, without them, a version that has."""
        if set(self.scope) <= set(chunk_rows.columns):
            chunk_rows = chunk_rows.where(self._scoped(chunk_rows))
        elif versions is not None:
            chunk_rows = chunk_rows.join(versions.where(self._scoped(versions)).select("document_id").distinct(), "document_id", "left_semi")
        else:
            self._scoped(chunk_rows)
        return documents.search_documents(queries, chunk_rows, limit, neighbors, versions=versions)
