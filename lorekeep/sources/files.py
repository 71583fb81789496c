"""Readers and writers: text and binary documents, evaluation datasets and single tables; snapshots are in ``snapshots``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import export_namespace, import_namespace, violations  # noqa: F401  (also found here)

#: Where a swap keeps the old table until the new one is in place.
ASIDE = ".__old__"
#: Suffixes of media that are text themselves; others need an extractor (see ``extracted``).
TEXT_SUFFIXES = ("txt", "md", "csv", "json", "jsonld", "xml", "yaml", "yml", "html")


def text_documents(spark: SparkSession, path: str, max_bytes: int = 1_000_000) -> DataFrame:
    """A row per text file: source_key (its path), content and content_hash. Longer files and other media are in ``left_out``."""
    files = spark.read.format("binaryFile").load(path).where(_fault(max_bytes).isNull())
    rows = files.select(F.col("path").alias("source_key"), F.decode("content", "UTF-8").alias("content"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def _fault(max_bytes: int) -> Column:
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return F.when(~suffix.isin(*TEXT_SUFFIXES), "media").when(F.col("length") > max_bytes, "size")


def left_out(spark: SparkSession, path: str, max_bytes: int = 1_000_000) -> DataFrame:
    """A row per file that ``text_documents`` does not read: source_key, length and reason (media or size). The contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").withColumn("reason", _fault(max_bytes))
    return files.where("reason is not null").select(F.col("path").alias("source_key"), "length", "reason")


def extracted(spark: SparkSession, path: str, extractor) -> DataFrame:
    """Binary documents as markdown by a given Pandas UDF of (bytes) -> text; a file it can't read has null content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source_key"), extractor(F.col("content")).alias("content"), "length")


def verified(originals: DataFrame) -> DataFrame:
    """Originals (id, content, content_hash, bytes) whose bytes or size no longer match."""
    return originals.where((F.sha2("content", 256) != F.col("content_hash")) | (F.octet_length("content") != F.col("bytes")))


def dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An evaluation dataset: a JSON array or one object a file; give a schema to spare Spark a pass."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def stage_and_swap(df: DataFrame, path: str) -> None:
    """Puts ``df`` in the place of the table at ``path``, written whole under a staging name first. The old table is moved aside, not deleted,
    until the new one is in place: if the job dies in between, ``recovered`` puts it back. Tables that belong together are committed
    at once by ``snapshots.Store``."""
    spark, staging = df.sparkSession, f"{path}.__import__{uuid.uuid4().hex}"
    df.write.parquet(staging)
    recovered(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, source, aside = hadoop.Path(path), hadoop.Path(staging), hadoop.Path(f"{path}{ASIDE}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(source, target):
        recovered(spark, path)
        raise OSError(f"{staging} could not be renamed to {path}")
    fs.delete(aside, True)


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, after what a swap that died has left: the old table is back if the new one never came, else it is gone."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, aside = hadoop.Path(path), hadoop.Path(f"{path}{ASIDE}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"{path}{ASIDE} could not be put back")
    return path
