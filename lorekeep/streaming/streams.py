"""Structured Streaming forms of the log roll-ups, idempotent claims and the webhook outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics


def daily_usage(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests per workspace and UTC day of a stream; a day is final once the watermark has passed it."""
    ok = F.count_if(F.col("status") == "success")
    rows = requests.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "workspace_id")
    return rows.agg(F.count("*").alias("requests"), ok.alias("successes"), F.avg("latency_ms").alias("avg_latency_ms")).select(analytics.day("window.start"), "workspace_id", "requests", "successes", "avg_latency_ms")


def first_claims(operations: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first operation of each namespace and idempotency key within the watermark; state is dropped behind it."""
    return operations.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["namespace_id", "idempotency_key"])


def rate_counts(requests: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", limit: int = 600, late: str = "1 minute") -> DataFrame:
    """Identities over their limit in a sliding window."""
    counted = requests.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide), "api_token_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("window.end").alias("until"), "api_token_id", "n")


def deliveries(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Events fanned out to the endpoints that ask for their type. endpoints: endpoint_id, event_types (array)."""
    kinds = endpoints.select("endpoint_id", F.explode("event_types").alias("event_type"))
    return events.join(F.broadcast(kinds) if not events.isStreaming else kinds, "event_type")


def outbox(stream: DataFrame, endpoints: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Writes each micro-batch's deliveries by ``send``; with the batch id a receiver can drop repeats."""
    return stream.writeStream.foreachBatch(lambda df, epoch: send(deliveries(df, endpoints), epoch)).option("checkpointLocation", checkpoint).start()


def batch_daily_usage(requests: DataFrame) -> DataFrame:
    return analytics.request_totals(requests, "workspace_id", analytics.day())
