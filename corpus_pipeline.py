"""A corpus run in five stages: quality classifier, SimHash near-duplicates, benchmark decontamination, mixing
sources to target weights, sharding. Each stage works on all that the one before it kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table (which gives an
empty table), and returns the columns of its input as they are, whatever their names; the last one adds ``shard``, in place of a
column of that name. What a stage does with nulls and ties is its operator's rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, mixing, nbsvm, sharding, simhash
from lorekeep.llm.common import materialize, packed, table, unpacked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    rows = nbsvm.scored(packed(docs, "doc_id", "text"), model, 0.5).where("predicted = 1")
    return unpacked(rows, docs.columns, ("doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest doc_id (null last), then of the least text hash."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    rows = decontaminate.mark(packed(docs, "text"), table(spark, sf_dir, "benchmark"), into="leak").where("not leak.contaminated")
    return unpacked(rows, docs.columns, ("text",))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its target."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row."""
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Trained models and 64-bit hashes are beyond SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
