"""Roll-ups over memories, request logs and provider usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from .filters import visible

ENTITY_ORDER = ("user", "agent", "run")


def scope_entities(memories: DataFrame) -> DataFrame:
    """Per namespace and entity (type, id): visible memories, first created, last updated. Blank ids are none."""
    kinds = F.array(*[F.struct(F.lit(i).alias("type_order"), F.lit(t).alias("type"), F.col(f"{t}_id").alias("entity_id")) for i, t in enumerate(ENTITY_ORDER)])
    rows = memories.where(visible()).select("namespace_id", "created_at", "updated_at", F.explode(kinds).alias("e")).select("*", "e.*").where("entity_id is not null and entity_id <> ''")
    return rows.groupBy("namespace_id", "type", "type_order", "entity_id").agg(F.count("*").alias("memories"), F.min("created_at").alias("first_created"), F.max("updated_at").alias("last_updated"))


def namespace_stats(memories: DataFrame) -> DataFrame:
    present = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = memories.where(visible()).groupBy("namespace_id").agg(F.count("*").alias("total_memories"), *[F.count_distinct(present(f"{t}_id")).alias(t) for t in ENTITY_ORDER])
    return rows.select("namespace_id", "total_memories", sum((F.col(t) for t in ENTITY_ORDER[1:]), F.col(ENTITY_ORDER[0])).alias("total_entities"))


def request_totals(requests: DataFrame, *by: str | Column) -> DataFrame:
    """Requests, success per cent to one digit (100 without any) and mean latency."""
    ok = F.count_if(F.col("status") == "success")
    n = F.count("*")
    rows = requests.groupBy(*by).agg(n.alias("requests"), ok.alias("successes"), F.avg("latency_ms").alias("avg"))
    return rows.withColumns({"success_rate": F.when(F.col("requests") == 0, 100.0).otherwise(round_half_up(1000.0 * F.col("successes") / F.col("requests")) / 10), "avg_latency_ms": F.coalesce(round_half_up(F.col("avg")), F.lit(0))}).drop("avg")


def day(ts: str = "created_at") -> Column:
    """The UTC day of an instant, whatever the session's time zone is."""
    return F.date_from_unix_date(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000).cast("int")).cast("string").alias("day")


def top_shares(requests: DataFrame, key: str, missing: str | None = None, limit: int | None = None) -> DataFrame:
    """Requests per workspace and key with the rounded percentage, most first; null keys as ``missing``."""
    name = F.coalesce(F.col(key), F.lit(missing)) if missing else F.col(key)
    rows = requests.groupBy("workspace_id", name.alias("name")).agg(F.count("*").alias("requests"))
    whole = Window.partitionBy("workspace_id")
    rows = rows.withColumns({"share": round_half_up(100.0 * F.col("requests") / F.sum("requests").over(whole)), "rank": F.row_number().over(whole.orderBy(F.desc("requests"), "name"))})
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def request_summary(requests: DataFrame) -> DataFrame:
    op = F.col("operation")
    return requests.groupBy("workspace_id").agg(F.count("*").alias("requests"), F.count_if(op.isin("memories.add", "documents.ingest")).alias("additions"), F.count_if(op.isin("memories.search", "memories.list")).alias("retrievals"), F.count_if(F.col("status") == "failed").alias("failures"))


def latest(requests: DataFrame, limit: int = 200) -> DataFrame:
    """The latest rows of each workspace, with whether there are more."""
    w = Window.partitionBy("workspace_id")
    rows = requests.withColumns({"place": F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("id"))), "n": F.count("*").over(w)})
    return rows.where(F.col("place") <= limit).withColumn("truncated", F.col("n") > limit).drop("n")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with cost_micros by the price in force: the last effective one, a workspace's own before a global one;
    null without any. prices is small reference data: its intervals are built once and joined on the model."""
    known = prices.select(F.col("id").alias("price_id"), F.col("workspace_id").alias("price_workspace"), F.col("model").alias("price_model"), "input_micros", "output_micros", "effective_at")
    until = Window.partitionBy("price_model", "price_workspace").orderBy("effective_at", "price_id")
    known = known.withColumn("until", F.lead("effective_at").over(until))
    at = F.col("created_at").cast("timestamp")
    holds = (F.col("model") == F.col("price_model")) & (F.col("effective_at") <= at) & (F.col("until").isNull() | (at < F.col("until")))
    own = known.where("price_workspace is not null")
    shared = known.where("price_workspace is null").select(*[F.col(c).alias(f"g_{c}") for c in known.columns])
    g_holds = (F.col("model") == F.col("g_price_model")) & (F.col("g_effective_at") <= at) & (F.col("g_until").isNull() | (at < F.col("g_until")))
    rows = usage.join(own, holds & (F.col("workspace_id") == F.col("price_workspace")), "left").join(shared, g_holds, "left")
    price = lambda c: F.coalesce(c, f"g_{c}")
    cost = round_half_up((F.col("input_tokens") * price("input_micros") + F.col("output_tokens") * price("output_micros")) / 1e6)
    return rows.select(*usage.columns, price("price_id").alias("price_id"), cost.cast("long").alias("cost_micros"))


def observability(priced_usage: DataFrame) -> DataFrame:
    p = F.col("kind") == "provider_usage"
    return priced_usage.groupBy("workspace_id").agg(
        F.count("*").alias("events"), F.sum(F.when(p, F.col("input_tokens"))).alias("input_tokens"), F.sum(F.when(p, F.col("output_tokens"))).alias("output_tokens"),
        F.sum(F.when(p, F.col("cost_micros"))).alias("cost_micros"), F.count_if(p & F.col("cost_micros").isNull()).alias("unpriced"), F.count_if(~p).alias("warnings"), F.sum("retry_count").alias("retries"),
        F.expr("percentile_disc(0.5) within group (order by latency_ms)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("long").alias("p95"),
    )


def time_buckets(events: DataFrame, start: Column, end: Column, n: int, key: str, ts: str = "created_at") -> DataFrame:
    """Counts per key in n equal buckets of [start, end); every bucket has a row for every key."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    width = (ms(end) - ms(start)) / n
    at = F.least(F.floor((ms(F.col(ts)) - ms(start)) / width), F.lit(n - 1)).cast("int")
    counts = events.where((ms(F.col(ts)) >= ms(start)) & (ms(F.col(ts)) <= ms(end))).groupBy(at.alias("bucket"), key).agg(F.count("*").alias("n"))
    grid = events.select(key).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counts, ["bucket", key], "left").select("bucket", key, F.coalesce("n", F.lit(0)).alias("n"))


def bucket_count(span_days: float) -> int:
    return 12 if span_days <= 1.5 else max(2, min(30, int(span_days + 0.5)))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


def activity(feeds: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """The latest rows of several feeds (id, created_at) in one."""
    rows = None
    for name, df in feeds.items():
        part = df.select(F.lit(name).alias("feed"), F.col("id").cast("string").alias("id"), "created_at")
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy(F.desc("created_at"), F.desc("id"), "feed").limit(limit)


def scope_entity_counts(memories: DataFrame, by: str = "namespace_id") -> DataFrame:
    """Memories and distinct users, agents and runs of each namespace; blank ids are none."""
    ids = {c: F.count_distinct(F.when(F.col(c) != "", F.col(c))) for c in ("user_id", "agent_id", "run_id")}
    rows = memories.where("not forgotten").groupBy(by).agg(F.count("*").alias("memories"), *[n.alias(c) for c, n in ids.items()])
    return rows.select(by, "memories", (F.col("user_id") + F.col("agent_id") + F.col("run_id")).alias("entities"))


def recent_summary(memories: DataFrame, since: Column, by: str = "namespace_id", most: int = 3) -> DataFrame:
    """Totals of each namespace, how many rows were made and recalled since a time, and the latest of both."""
    accessed = F.col("access_count") > 0
    rows = memories.where("not forgotten")
    totals = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("created_at") >= since).alias("remembered"), F.count_if(accessed & (F.col("last_accessed_at") >= since)).alias("recalled"))

    def latest(of: DataFrame, key: str, name: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc(key), F.desc("created_at"), F.desc("id"))
        first = of.select(by, "id", F.row_number().over(order).alias("n")).where(F.col("n") <= most)  # cut before the shuffle
        return first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "id")))["id"].alias(name))

    return totals.join(latest(rows, "created_at", "latest"), by, "left").join(latest(rows.where(accessed), "last_accessed_at", "latest_recalled"), by, "left")


def memory_events(tasks: DataFrame, status: Column) -> DataFrame:
    """Tasks as events: the public status, the outcome of finished ones and the latency, never below 0. tasks: id, stored
    (how many memories a task wrote), started_at, completed_at."""
    ms = (F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).cast("long")
    done = F.when(status == "SUCCEEDED", F.when(F.col("stored") > 0, "STORED").otherwise("NO_MEMORY"))
    return tasks.select("id", status.alias("status"), done.alias("outcome"), F.greatest(F.lit(0).cast("long"), ms).alias("latency_ms"))
