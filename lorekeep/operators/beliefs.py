"""Evidence competition: which value of a slot its observations support."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    evidence: int = 3
    contexts: int = 3
    support: float = 0.6
    lead: float = 1.0


def active_at(evidence: DataFrame, at: Column) -> DataFrame:
    return evidence.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def observe(evidence: DataFrame, cluster: tuple[str, ...] = ("subject", "attribute")) -> DataFrame:
    """One row per cluster and source (the id): the last observation stands."""
    last = Window.partitionBy(*cluster, "id").orderBy(F.desc("observed_at"), F.desc("value_key"))
    return evidence.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def without_conflicts(evidence: DataFrame, cluster: tuple[str, ...] = ("subject", "attribute")) -> DataFrame:
    """Drops evidence keys that claim more than one value in a cluster."""
    torn = evidence.groupBy(*cluster, "evidence_key").agg(F.min("value_key").alias("a"), F.max("value_key").alias("b")).where("a <> b")
    return evidence.join(torn, [*cluster, "evidence_key"], "left_anti")


def candidates(evidence: DataFrame, cluster: tuple[str, ...] = ("subject", "attribute")) -> DataFrame:
    """Score, evidence and contexts of every value: an evidence key counts once, with its largest weight and the
    context of its earliest row."""
    once = evidence.groupBy(*cluster, "value_key", "evidence_key").agg(F.max("weight").alias("weight"), F.min_by("context_id", F.struct("observed_at", "id")).alias("context_id"), F.min("observed_at").alias("first_observed"))
    by_value = once.groupBy(*cluster, "value_key").agg(F.round(F.sum("weight"), 9).alias("score"), F.count("*").alias("evidence_count"), F.count_distinct("context_id").alias("context_count"), F.min("first_observed").alias("first_observed"))
    return by_value.withColumn("support", F.col("score") / F.sum("score").over(Window.partitionBy(*cluster)))


def ranked(found: DataFrame, policy: Policy = Policy(), cluster: tuple[str, ...] = ("subject", "attribute")) -> DataFrame:
    """rank, lead over the runner-up, status and reason of every candidate; the winner passes all four thresholds."""
    order = Window.partitionBy(*cluster).orderBy(F.desc("score"), F.desc("evidence_count"), "first_observed", "value_key")
    rows = found.withColumns({"rank": F.row_number().over(order), "next_score": F.lead("score").over(order)})
    lead = F.round(F.col("score") - F.coalesce("next_score", F.lit(0.0)), 9)
    gates = [("low_evidence", F.col("evidence_count") < policy.evidence), ("low_contexts", F.col("context_count") < policy.contexts), ("low_support", F.col("support") < policy.support), ("low_lead", lead < policy.lead)]
    rows = rows.withColumns({"lead": lead, "reasons": F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in gates])), ",")})
    wins = (F.col("rank") == 1) & (F.col("reasons") == "")
    won = F.max(wins).over(Window.partitionBy(*cluster))
    return rows.withColumn("status", F.when(wins, "supported").when(won, "superseded").otherwise("contested")).drop("next_score")


def view(evidence: DataFrame, at: Column, policy: Policy = Policy(), mode: str = "default") -> DataFrame:
    """mode default: winners; conflict and audit: all candidates."""
    rows = ranked(candidates(without_conflicts(active_at(observe(evidence), at))), policy)
    return rows.where("status = 'supported'") if mode == "default" else rows


def shadow_diff(state: DataFrame, winners: DataFrame) -> DataFrame:
    """Current state against winners, by subject and attribute. state: subject, attribute, state_value."""
    both = state.join(winners.select("subject", "attribute", F.col("value_key").alias("belief_value")), ["subject", "attribute"], "full")
    s, b = F.col("state_value"), F.col("belief_value")
    return both.withColumn("verdict", F.when(s.isNull() & b.isNull(), "empty").when(b.isNull(), "state_only").when(s.isNull(), "belief_only").when(s == b, "agreement").otherwise("disagreement"))


def contextual_view(evidence: DataFrame, requested: DataFrame, at: Column, policy: Policy = Policy()) -> DataFrame:
    """The winner of every slot in each requested context: the context's own, else the global one where the context has no
    active evidence at all (a contested context hides the global winner). evidence: ``applicability``, null for global;
    requested: subject, attribute, applicability."""
    slot = ("subject", "attribute", "applicability")
    rows = active_at(observe(evidence.withColumn("applicability", F.coalesce("applicability", F.lit(""))), slot), at)
    found = ranked(candidates(without_conflicts(rows, slot), slot), policy, slot)
    best = found.groupBy(*slot).agg(F.max(F.when(F.col("status") == "supported", F.col("value_key"))).alias("own"))
    common = best.where("applicability = ''").select("subject", "attribute", F.col("own").alias("common"))
    asked = requested.select(*slot).where("applicability <> ''").distinct()
    both = asked.join(best.withColumn("active", F.lit(True)), list(slot), "left").join(common, ["subject", "attribute"], "left")
    value = F.coalesce("own", F.when(F.col("active").isNull(), F.col("common")))
    reason = F.when(F.col("own").isNotNull(), "contextual_override").when(value.isNotNull(), "global_fallback")
    return both.select(*slot, value.alias("value_key"), reason.alias("reason"))
