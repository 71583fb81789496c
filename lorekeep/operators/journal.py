"""The write path as batch folds over logs: claims, mutations, queues, feedback and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_IMPORTANCE, lookup, trim_space


def add_verbatim(messages: DataFrame) -> DataFrame:
    """One row per message that is not blank, byte for byte."""
    return messages.where(F.length(trim_space(F.col("text"))) > 0)


def with_defaults(records: DataFrame, default_type: str = "fact") -> DataFrame:
    """memory_type: the call's, then the extracted one, then the default; importance: given or by type, within 0 and 1."""
    kind = F.coalesce("call_type", "extracted_type", F.lit(default_type))
    return records.withColumn("memory_type", kind).withColumn("importance", F.least(F.greatest(F.coalesce("importance", lookup(DEFAULT_IMPORTANCE, kind)), F.lit(0.0)), F.lit(1.0)))


def claims(operations: DataFrame) -> DataFrame:
    """What happens to each operation (namespace_id, idempotency_key, request_hash, seq): the first of a key is
    ``accepted``, a later one of the same hash is a ``replay``, of another a ``conflict``."""
    first = Window.partitionBy("namespace_id", "idempotency_key").orderBy("seq")
    rows = operations.withColumns({"n": F.row_number().over(first), "first_hash": F.first("request_hash").over(first)})
    return rows.withColumn("outcome", F.when(F.col("n") == 1, "accepted").when(F.col("request_hash") == F.col("first_hash"), "replay").otherwise("conflict")).drop("n", "first_hash")


def fold(base: DataFrame, log: DataFrame, columns: list[str]) -> DataFrame:
    """The table after a mutation log (id, seq, op, the columns, and sets): for each column the last update that sets it; rows
    whose last delete or purge has no later update are gone.

    An update sets the columns that ``sets`` (an array of names) lists, to null too; where it is null, or the log has no such column, those that are not null.
    ``add`` sets all columns, and makes the row if it is not there; its other columns are then null."""
    log = log if "sets" in log.columns else log.withColumn("sets", F.lit(None).cast("array<string>"))
    told = lambda c: (F.col("op") == "add") | F.coalesce(F.array_contains("sets", F.lit(c)), F.col(c).isNotNull())
    set_ = log.where("op in ('update', 'add')").groupBy("id").agg(*[F.max_by(F.struct(c), F.when(told(c), F.col("seq"))).alias(f"__{c}") for c in columns], F.max("seq").alias("__updated"))
    gone = log.where("op in ('delete', 'purge')").groupBy("id").agg(F.max("seq").alias("__gone"))
    made = log.where("op = 'add' and id is not null").select("id").distinct().join(base, "id", "left_anti")
    rows = base.unionByName(made, allowMissingColumns=True).join(set_, "id", "left").join(gone, "id", "left").where("__gone is null or __updated > __gone")
    return rows.withColumns({c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}")[c]).otherwise(F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns], "__updated", "__gone")


def version_check(updates: DataFrame, memories: DataFrame) -> DataFrame:
    """ok, conflict or missing for each update (id, version): version is the updated_at that the caller saw."""
    rows = updates.join(memories.select("id", "updated_at"), "id", "left")
    return rows.withColumn("outcome", F.when(F.col("updated_at").isNull(), "missing").when(F.col("version") == F.col("updated_at"), "ok").otherwise("conflict")).drop("updated_at")


def due(tasks: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Tasks to take: pending or retry whose time has come, or processing whose lease is over; oldest first."""
    ready = (F.col("status").isin("pending", "retry") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "processing") & (F.col("lease_until") < now))
    return tasks.where(ready).orderBy("next_attempt_at", "id").limit(limit)


def after_failure(tasks: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """The next state of failed tasks: retry after min(60 s * 2 ** (attempts - 1), 1 h), dead at the last attempt."""
    wait = F.least(60 * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(3600.0))
    over = F.col("attempts") >= max_attempts
    return tasks.withColumns({"status": F.when(over, "dead").otherwise("retry"), "next_attempt_at": F.when(~over, F.timestamp_micros(F.unix_micros(now) + (wait * 1_000_000).cast("long")))})


def feedback(history: DataFrame) -> DataFrame:
    """The last FEEDBACK event of each memory; a null value clears it."""
    rows = history.where("event = 'FEEDBACK'").groupBy("memory_id").agg(F.max_by(F.struct("new_value"), F.struct("created_at", "id")).alias("last"))
    return rows.select("memory_id", F.col("last.new_value").alias("feedback")).where("feedback is not null")


def history(log: DataFrame, memory_id: str) -> DataFrame:
    return log.where(F.col("memory_id") == memory_id).orderBy("created_at", "id")


def verify_projection(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Differences between the canonical rows and their projection (id, content): missing, orphan or stale."""
    m = memories.where("not forgotten").select("id", F.col("content").alias("canonical"))
    both = m.join(vectors.select(F.col("id").alias("vid"), F.col("content").alias("projected")), F.col("id") == F.col("vid"), "full")
    return both.select(F.coalesce("id", "vid").alias("id"), F.when(F.col("vid").isNull(), "missing").when(F.col("id").isNull(), "orphan").when(~F.col("canonical").eqNullSafe(F.col("projected")), "stale").alias("problem")).where("problem is not null")


def delete_all(memories: DataFrame, where: Column, most: int = 25_000) -> DataFrame:
    """The rows that stay; an error before anything is deleted if more than ``most`` match."""
    if len(memories.where(where).select("id").limit(most + 1).take(most + 1)) > most:
        raise ValueError(f"more than {most} rows match")
    return memories.where(~F.coalesce(where, F.lit(False)))


def event_status(status: Column) -> Column:
    return F.when(status.isin("pending", "awaiting_upload"), "PENDING").when(status == "processing", "RUNNING").when(status == "retry", "RETRYING").when(status == "success", "SUCCEEDED").otherwise("FAILED")
