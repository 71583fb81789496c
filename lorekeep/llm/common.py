"""Shared pieces of the training-data operators: tables, folds, scratch space and batching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word in the contracts: the space and the five ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text that one vectorised step inside a task holds at once; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def unit_hash(column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone (a null: as an empty text)."""
    text = F.concat_ws(":", F.lit(str(seed)), column.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """``docs`` as its ``keys`` (those that it has) and one struct ``row`` of all other columns: whatever names a table has,
    none of them meets an operator's own. See ``unpacked``."""
    others = [quoted(c) for c in docs.columns if c not in keys]
    return docs.select(*(k for k in keys if k in docs.columns), (F.struct(*others) if others else F.lit(True)).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], keys: tuple[str, ...], *more: Column) -> DataFrame:
    """The ``columns`` that a table had before ``packed``, in their order, and ``more`` columns of ``rows``."""
    return rows.select(*(F.col(c) if c in keys else F.col("row").getField(c).alias(c) for c in columns), *more)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a single-JVM session, where driver and
    executors share a disk, may do without; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return "/tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared scratch folder and reads it back: cuts the lineage, so that a
    lost executor costs its own tasks only, and a later pass does not compute the input again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batch: pa.RecordBatch, column: str, max_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of an Arrow batch with the UTF-8 bytes of a text column (null: empty), about ``max_bytes`` each."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, int)
    start = held = 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > max_bytes:
            yield batch.slice(start, row - start), texts.slice(start, row - start).to_pylist()
            start, held = row, 0
        held += size + 1
    if start < len(texts):
        yield batch.slice(start), texts.slice(start).to_pylist()


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch with columns added (or replaced), in the order of ``schema``."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays([have[f.name] if isinstance(have[f.name], pa.Array) else pa.array(have[f.name], f.type) for f in schema], schema=schema)
