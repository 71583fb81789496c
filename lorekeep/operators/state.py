"""Slots of state as closed-open intervals, and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import key_of, value_key

ELIGIBLE_TYPES = ("fact", "preference", "identity", "decision")


def eligible(memory_type: Column) -> Column:
    return memory_type.isNull() | memory_type.isin(*ELIGIBLE_TYPES)


def slots(observations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Single-valued slots from observations (seq, subject, attribute, value, valid_from, source_id): equal values in a
    row are one interval that gathers its sources; another value closes it at its own valid_from."""
    base = observations.withColumns({"subject_key": key_of(F.col("subject")), "attribute_key": key_of(F.col("attribute")), "value_norm": value_key(F.col("value"))})
    keys = [*scope, "subject_key", "attribute_key"]
    along = Window.partitionBy(*keys).orderBy("seq")
    base = base.withColumn("island", F.sum((~F.col("value_norm").eqNullSafe(F.lag("value_norm").over(along))).cast("int")).over(along))
    rows = base.groupBy(*keys, "island").agg(F.min_by("value", "seq").alias("value"), F.min_by("valid_from", "seq").alias("valid_from"), F.min("seq").alias("seq"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    return rows.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("island")))


def multi_slots(observations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Multi-valued slots: every distinct value opens once and stays open."""
    base = observations.withColumns({"subject_key": key_of(F.col("subject")), "attribute_key": key_of(F.col("attribute")), "value_norm": value_key(F.col("value"))})
    return base.groupBy(*scope, "subject_key", "attribute_key", "value_norm").agg(F.min_by("value", "seq").alias("value"), F.min_by("valid_from", "seq").alias("valid_from"), F.min("seq").alias("seq"), F.array_sort(F.collect_set("source_id")).alias("sources")).withColumn("valid_to", F.lit(None).cast("timestamp"))


def current(slot_rows: DataFrame) -> DataFrame:
    """The first open row of each slot."""
    rows = slot_rows.where("valid_to is null")
    return rows.groupBy("subject_key", "attribute_key").agg(F.min_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")


def as_of(slot_rows: DataFrame, at: Column) -> DataFrame:
    """The row of each slot whose interval, open at its end, holds the time; the earliest of several."""
    rows = slot_rows.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    return rows.groupBy("subject_key", "attribute_key").agg(F.min_by(F.struct(*rows.columns), F.struct("valid_from", "seq")).alias("r")).select("r.*")


def belief_at(memories: DataFrame, at: Column) -> DataFrame:
    """Memories of slots with whether they hold at a time, and their place on the slot's timeline."""
    start = F.coalesce("valid_from", "event_date", "created_at")
    shown = F.coalesce("event_date", "valid_from", "created_at")
    rows = memories.where("subject is not null and attribute is not null")
    rows = rows.withColumn("valid", (start <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))).withColumn("shown_at", shown)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lower("subject"), F.lower("attribute")).orderBy("shown_at", "id")))


def summary_text(slot_rows: DataFrame) -> DataFrame:
    """A deterministic text for each slot: its current value and its timeline."""
    line = F.concat_ws(" ", F.date_format("valid_from", "yyyy-MM-dd"), F.lit("-"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("now")), F.lit(":"), "value")
    rows = slot_rows.groupBy("subject_key", "attribute_key").agg(F.max(F.when(F.col("valid_to").isNull(), F.col("value"))).alias("now"), F.array_sort(F.collect_list(F.struct("valid_from", "seq", line.alias("line")))).alias("lines"), F.count("*").alias("n"))
    return rows.select("subject_key", "attribute_key", F.concat_ws("\n", F.concat_ws(" ", F.lit("Belief slot"), "subject_key", F.lit("/"), "attribute_key"), F.concat_ws(" ", F.lit("Current:"), F.coalesce("now", F.lit("unknown"))), F.lit("Timeline:"), F.array_join("lines.line", "\n"), F.concat_ws(" ", F.lit("Evidence:"), F.col("n").cast("string"))).alias("summary"))
