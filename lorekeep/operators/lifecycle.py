"""The life of rows beyond reads: purges, promotion, merges, operations and batches, and the tables around them.

Writes are folds: each gives the new state of a table, of all tenants, and changes nothing in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_terms, fnv1a, stable_uuid, words_of
from ..scratch import kept
from . import maintenance

MAX_ITEMS, MAX_BYTES, STEP_ITEMS = 1000, 750_000, 20
STALE_MINUTES = 5
# The days of a named range; "all" has no start, "today" begins at midnight (UTC).
RANGE_DAYS = {"today": 0, "last_7_days": 7, "last_30_days": 30, "last_90_days": 90}


def page_of(rows: DataFrame, by: list[str], order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """The rows at places offset + 1 to offset + limit of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position`` from 0 in the order of whole tables: sorted in ranges, each range's rows numbered in its own task and moved by
    the number of rows before it."""
    dealt = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    ahead = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))  # a row per range
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("position", nth - 1).join(F.broadcast(ahead), "__part").withColumn("position", F.col("position") + F.col("__ahead")).drop("__part", "__ahead")


def stride_sample(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """Every n-th row in order, n being the rows by ``most`` rounded down (1 at least): the first ``most`` of them."""
    every = max(1, rows.count() // most)
    return numbered(rows, *order).where((F.col("position") % every == 0) & (F.col("position") < every * most)).drop("position")


def without(memories: DataFrame, edges: DataFrame, mentions: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the given memories, their edges (at either end) and mentions. ids: id."""
    gone = ids.select("id").distinct()
    return {
        "memories": memories.join(gone, "id", "left_anti"),
        "edges": edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"),
        "mentions": mentions.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti"),
    }


def purged(memories: DataFrame, edges: DataFrame, mentions: DataFrame, namespace: str) -> dict[str, DataFrame]:
    """The tables after all of a namespace is deleted."""
    return without(memories, edges, mentions, memories.where(F.col("namespace_id") == namespace))


def promoted(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Rows with a tier: the given ids are in the working set, and touched now; the others keep theirs (none: long)."""
    tier = F.col("tier") if "tier" in memories.columns else F.lit(None).cast("string")
    rows = memories.withColumn("tier", F.coalesce(tier, F.lit("long"))).join(ids.select("id", F.lit(True).alias("__up")).distinct(), "id", "left")
    touched = {c: F.when(F.col("__up"), now).otherwise(F.col(c)) for c in ("updated_at", "last_accessed_at")}
    return rows.withColumns({"tier": F.when(F.col("__up"), "working").otherwise(F.col("tier")), **touched}).drop("__up")


def merge_roots(pairs: DataFrame) -> DataFrame:
    """(loser, winner) of pairs (winner, loser): each loser once, with the row that is left in the end. Of several winners of a row the least counts; a winner
    that loses elsewhere hands its losers on; of rows that win over each other in a ring the least is left.

    Pointers are doubled, so a chain of n rows takes about log2(n) rounds; each is written."""
    now = pairs.where("winner <> loser").groupBy("loser").agg(F.min("winner").alias("winner"))
    # the least row that a pointer has passed is the root of a ring
    now = kept(now.withColumn("least", F.least("loser", "winner")), "merge-roots")
    n, rounds = now.count(), 0
    while rounds < max(1, n.bit_length() + 1):
        further = now.select(F.col("loser").alias("__row"), F.col("winner").alias("__next"), F.col("least").alias("__least"))
        now = kept(now.join(further, F.col("winner") == F.col("__row"), "left").select("loser", F.coalesce("__next", "winner").alias("winner"), F.least("least", F.coalesce("__least", "least")).alias("least")), "merge-roots")
        rounds += 1
    ends = now.select(F.col("loser").alias("__row"), F.lit(True).alias("ring"))
    return now.join(ends, F.col("winner") == F.col("__row"), "left").select("loser", F.when(F.col("ring"), F.col("least")).otherwise(F.col("winner")).alias("winner")).where("loser <> winner")


def merged(memories: DataFrame, edges: DataFrame, mentions: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The tables after merges (winner, loser, content): the winner has the content, the loser is forgotten, edges and mentions of the loser are the
    winner's (no loops, the largest weight), and the winner updates the loser.

    Pairs are brought to ``merge_roots`` first, so a row has one winner, which stays. A winner of one loser by one pair has that pair's content; one of
    several has its own and theirs, one after another by id, as ``maintenance.merged_content`` puts two together; the distinct texts of its losers are one
    array."""
    given = kept(pairs.where("winner <> loser").groupBy("winner", "loser").agg(F.min("content").alias("content")), "merge-pairs")
    p = kept(merge_roots(given), "merges")
    sole = p.groupBy("winner").agg(F.count("*").alias("losers"), F.min("loser").alias("loser"))
    simple = sole.where("losers = 1").join(given, ["winner", "loser"]).select(F.col("winner").alias("id"), F.col("content").alias("__one"))
    several = p.join(memories.select(F.col("id").alias("loser"), F.col("content").alias("__text")), "loser").groupBy("winner", F.coalesce("__text", F.lit("")).alias("text")).agg(F.min("loser").alias("loser"))
    several = several.groupBy(F.col("winner").alias("id")).agg(F.array_sort(F.collect_list(F.struct("loser", "text"))).alias("__all"))
    lost = p.select(F.col("loser").alias("id"), F.lit(True).alias("__lost"))
    rows = memories.join(simple, "id", "left").join(several, "id", "left").join(lost, "id", "left")
    folded = F.aggregate("__all", F.coalesce("content", F.lit("")), lambda text, other: maintenance.merged_content(text, other["text"]))
    content = F.coalesce("__one", F.when(F.col("__all").isNotNull(), folded), "content")
    rows = rows.withColumns({"content": content, "forgotten": F.coalesce("__lost", "forgotten")}).drop("__one", "__all", "__lost")
    of = lambda column: p.select(F.col("loser").alias(column), F.col("winner").alias("__w"))
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(of(end), end, "left").withColumn(end, F.coalesce("__w", end)).drop("__w")
    moved = moved.where("src <> dst").select("src", "dst", "relation", "weight").unionByName(p.select(F.col("winner").alias("src"), F.col("loser").alias("dst"), F.lit("updates").alias("relation"), F.lit(1.0).alias("weight")))
    told = mentions.join(of("memory_id"), "memory_id", "left").select(F.coalesce("__w", "memory_id").alias("memory_id"), "entity_id").distinct()
    return {"memories": rows, "edges": moved.groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight")), "mentions": told}


def invalidated(memories: DataFrame, edges: DataFrame, ends: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The tables after facts came to an end (id, and the successor's id or null): valid_to is ``at``, if they don't end before, superseded_by the successor,
    which also updates them, and history has an INVALIDATE row each (memory_id, event, old_value, new_value, created_at). Successors that
    are not there count as null; of repeated ids the least successor counts; a row is never its own."""
    known = memories.select(F.col("id").alias("successor"))
    told = ends.where("id is not null").join(known, "successor", "left_semi").where("successor <> id").groupBy("id").agg(F.min("successor").alias("successor"))
    hit = memories.select("id").join(ends.select("id").distinct(), "id", "left_semi").join(told, "id", "left")
    hit = kept(hit.select("id", F.col("successor").alias("__by"), F.lit(True).alias("__hit")), "invalidated")
    rows = memories.join(hit, "id", "left")
    old = rows.where("__hit").select(F.col("id").alias("memory_id"), F.lit("INVALIDATE").alias("event"), F.col("valid_to").cast("string").alias("old_value"), F.least(F.coalesce("valid_to", at), at).cast("string").alias("new_value"), at.alias("created_at"))
    before = F.col("superseded_by") if "superseded_by" in memories.columns else F.lit(None).cast(memories.schema["id"].dataType)
    rows = rows.withColumns({"valid_to": F.when(F.col("__hit"), F.least(F.coalesce("valid_to", at), at)).otherwise(F.col("valid_to")), "superseded_by": F.coalesce("__by", before)}).drop("__by", "__hit")
    new = hit.where("__by is not null").select(F.col("__by").alias("src"), F.col("id").alias("dst"), F.lit("updates").alias("relation"), F.lit(1.0).alias("weight"))
    both = edges.select("src", "dst", "relation", "weight").unionByName(new).groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"))
    return {"memories": rows, "edges": both, "history": old}


def entity_edges(batch: DataFrame, memories: DataFrame, mentions: DataFrame, most: int = 4, weight: float = 0.6) -> DataFrame:
    """Edges of new rows to the ``most`` rows, last updated first, that mention an entity of theirs. Of each entity only its ``most`` + 1
    last updated rows can be among them (one may be the new row), so a frequent entity is no join of all its rows."""
    rank = Window.partitionBy("entity_id").orderBy(F.desc("updated_at"), "dst")
    told = mentions.join(memories.select(F.col("id").alias("memory_id"), "updated_at"), "memory_id").select("entity_id", F.col("memory_id").alias("dst"), "updated_at")
    latest = told.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most + 1).drop("place")
    fresh = batch.select(F.col("id").alias("src")).join(mentions.withColumnRenamed("memory_id", "src"), "src")
    pairs = fresh.join(latest, "entity_id").where("src <> dst").select("src", "dst", "updated_at").distinct()
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("updated_at"), "dst"))).where(F.col("place") <= most)
    return best.select("src", "dst", F.lit("same_entity").alias("relation"), F.lit(weight).alias("weight"))


def named_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity_id): entities that a query names, in its text or word by word in its content terms. queries: qid, text;
    entities: id, name. Names are found by their words, never by a join of all with all."""
    asked = queries.select("qid", F.lower("text").alias("low"), content_terms(F.col("text")).alias("terms"))
    names = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("name"), F.array_distinct(words_of(F.col("name"))).alias("parts")).where(F.size("parts") > 0)
    said = asked.select("qid", F.explode(F.array_distinct(words_of(F.col("low")))).alias("word"))
    hit = names.select("entity_id", F.explode("parts").alias("word"), F.size("parts").alias("n")).join(said, "word").groupBy("qid", "entity_id", "n").agg(F.count("*").alias("found")).where("found = n")
    sure = hit.join(names, "entity_id").join(asked, "qid").where(F.col("low").contains(F.col("name")) | (F.size(F.array_except("parts", "terms")) == 0))
    return sure.select("qid", "entity_id")


#: Queries of an entity that go to its rows as one list; names of queries that are broadcast at once; pairs that a task gives.
LISTED, NAMED_BLOCK, TASK_PAIRS = 512, 1 << 17, 1 << 22


def entity_matches(queries: DataFrame, entities: DataFrame, mentions: DataFrame, pairs: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(qid, id, boost): rows that mention an entity that a query names; min(0.12, 0.3 / sqrt(rows of the entity)), the largest of a row's.
    entities: id, name. pairs (qid, id): those that are asked for alone, found without making the others; digits: boosts are rounded to.

    All pairs are as many as queries times rows of their entities. They are made by a join of an entity's rows with lists of its queries and are not
    shuffled: of the entities that a row and a query share, only the one of the largest boost gives the pair. Lists are broadcast a block at a time and
    rows are dealt out one by one, so tasks make about as many pairs each, however few the entities are."""
    sizes = mentions.groupBy("entity_id").agg(F.count("*").alias("rows"))
    boost = F.least(F.lit(0.12), 0.3 / F.sqrt(F.greatest("rows", F.lit(1))))
    named = named_entities(queries, entities)
    told = mentions.join(sizes, "entity_id").select("entity_id", F.col("memory_id").alias("id"), (boost if digits is None else F.round(boost, digits)).alias("boost")).distinct()
    if pairs is not None:
        return pairs.select("qid", "id").distinct().join(named, "qid").join(told, ["id", "entity_id"]).groupBy("qid", "id").agg(F.max("boost").alias("boost"))
    named = kept(named.distinct(), "named-entities")
    most, n, made = named.groupBy("entity_id").agg(F.count("*").alias("n")).join(sizes, "entity_id", "left").agg(F.max("n"), F.sum("n"), F.sum(F.col("n") * F.coalesce("rows", F.lit(0)))).first()
    whole = named.join(named.groupBy("qid").agg(F.collect_set("entity_id").alias("names")), "qid")
    order = F.array_sort(F.collect_set(F.struct((-F.col("boost")).alias("less"), "entity_id")))
    rows = told.groupBy("id").agg(order.alias("all")).select("id", F.col("all.entity_id").alias("held"), F.posexplode("all").alias("at", "one"))
    rows = kept(rows.select("id", F.col("one.entity_id").alias("entity_id"), (-F.col("one.less")).alias("boost"), F.slice("held", F.lit(1), F.col("at")).alias("before")), "entity-rows")
    blocks = max(1, -(-(n or 0) // NAMED_BLOCK))
    dealt = rows.repartition(max(-(-(made or 0) // (blocks * TASK_PAIRS)), rows.sparkSession.sparkContext.defaultParallelism))
    parts = []
    for k in range(blocks):
        some = whole.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        # another hash than the blocks', so that a block's queries are dealt over all lists
        lists = some.groupBy("entity_id", F.pmod(F.hash("qid"), F.lit(-(-(most or 0) // (blocks * LISTED)) or 1)).alias("list")).agg(F.collect_list(F.struct("qid", "names")).alias("asked")).drop("list")
        met = dealt.join(F.broadcast(lists), "entity_id").select("id", "boost", "before", F.explode("asked").alias("one"))
        parts.append(met.where((F.size("before") == 0) | ~F.arrays_overlap("before", "one.names")).select("one.qid", "id", "boost"))
    return reduce(DataFrame.unionByName, parts)


def evidence_after(evidence: DataFrame, log: DataFrame, source: str = "source_id", scope: str = "context_id") -> DataFrame:
    """Evidence after a log (op, key, at): ``invalidate`` ends a source's rows, if they don't end before; ``remove`` deletes a source's rows and
    ``clear`` a scope's."""
    ends = log.where("op = 'invalidate'").groupBy(F.col("key").alias(source)).agg(F.min("at").alias("__end"))
    gone = log.where("op = 'remove'").select(F.col("key").alias(source)).distinct()
    cleared = log.where("op = 'clear'").select(F.col("key").alias(scope)).distinct()
    rows = evidence.join(gone, source, "left_anti").join(cleared, scope, "left_anti").join(ends, source, "left")
    return rows.withColumn("valid_to", F.least("valid_to", "__end")).drop("__end")


def slot_document_id(key: Column) -> Column:
    """A UUID of version 4's form from four FNV-1a hashes of a slot's key."""
    h = F.concat(*[fnv1a(F.concat(F.lit(f"{k}:"), key)) for k in range(4)])
    part = lambda at, n: F.substr(h, F.lit(at), F.lit(n))
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("long") % 4 + 8))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def range_start(name: str, now: Column) -> Column:
    """The start of a named range up to ``now``, in UTC; null if it has none."""
    if name not in RANGE_DAYS:
        return F.lit(None).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(now) - F.unix_micros(now) % 86_400_000_000) if name == "today" else now - F.expr(f"interval {RANGE_DAYS[name]} days")


def task_health(tasks: DataFrame, warnings: DataFrame, now: Column, by: str = "workspace_id") -> DataFrame:
    """pending, dead, oldest_pending, warnings of the last 24 hours, and degraded (a dead task, or one pending for five minutes). tasks: by, status,
    created_at; warnings: by, created_at."""
    waiting = F.col("status").isin("pending", "processing", "retry")
    rows = tasks.groupBy(by).agg(F.count_if(waiting).alias("pending"), F.count_if(F.col("status") == "dead").alias("dead"), F.min(F.when(waiting, F.col("created_at"))).alias("oldest_pending"))
    recent = warnings.where(F.col("created_at") >= now - F.expr("interval 24 hours")).groupBy(by).agg(F.count("*").alias("warnings"))
    stale = F.coalesce(F.col("oldest_pending") <= now - F.expr(f"interval {STALE_MINUTES} minutes"), F.lit(False))
    return rows.join(recent, by, "left").withColumns({"warnings": F.coalesce("warnings", F.lit(0)), "degraded": (F.col("dead") > 0) | stale})


def item_outcome(status_code: Column) -> Column:
    """What an item's response means for its batch: client errors fail the item, others abort the step."""
    return F.when(status_code < 400, "succeeded").when(status_code < 500, "failed").otherwise("aborted")


def batch_summary(items: DataFrame, by: str = "batch_id") -> DataFrame:
    """succeeded, failed and processed items of each batch, and whether a step was aborted. items: by, outcome."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    rows = items.groupBy(by).agg(is_("succeeded").alias("succeeded"), is_("failed").alias("failed"), (is_("aborted") > 0).alias("aborted"))
    return rows.withColumn("processed", F.col("succeeded") + F.col("failed"))


def batch_checks(items: DataFrame, by: str = "batch_id") -> DataFrame:
    """Whether a batch may run (reason: null) and in how many steps. items: by, id, bytes."""
    rows = items.groupBy(by, "id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy(by).agg(F.sum("n").alias("items"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"))
    reason = F.when(F.col("items") > MAX_ITEMS, "too many items").when(F.col("bytes") > MAX_BYTES, "too large").when(F.col("most") > 1, "repeated id")
    return rows.select(by, "items", "bytes", F.ceil(F.col("items") / STEP_ITEMS).alias("steps"), reason.alias("reason"))


def frozen_plan(commands: DataFrame) -> DataFrame:
    """Commands (namespace_id, idempotency_key, position and more) with the id that each record will have, fixed before anything is written: a
    second run of the same command writes the same rows."""
    return commands.withColumn("memory_id", stable_uuid(F.concat_ws("\0", "namespace_id", "idempotency_key", F.col("position").cast("string"))))


def operation_states(log: DataFrame, now: Column) -> DataFrame:
    """The state of each operation after its log (operation_id, seq, event, lease_until): ``claim`` opens a lease, ``complete`` commits, ``fail``
    fails. claimable: failed, or processing with a lease that is over."""
    known = log.where(F.col("event").isin("claim", "complete", "fail"))
    last = known.groupBy("operation_id").agg(F.max_by(F.struct("event", "lease_until"), "seq").alias("last"), F.count_if(F.col("event") == "claim").alias("attempts"))
    status = F.when(F.col("last.event") == "complete", "committed").when(F.col("last.event") == "fail", "failed").otherwise("processing")
    rows = last.select("operation_id", "attempts", status.alias("status"), F.when(F.col("last.event") == "claim", F.col("last.lease_until")).alias("lease_until"))
    return rows.withColumn("claimable", (F.col("status") == "failed") | ((F.col("status") == "processing") & F.coalesce(F.col("lease_until") < now, F.lit(True))))


def journal_rows(log: DataFrame) -> DataFrame:
    """The events that finished operations append: a row per complete or fail, with an id by operation and order."""
    return log.where(F.col("event").isin("complete", "fail")).select(stable_uuid(F.concat_ws("\0", F.col("operation_id").cast("string"), F.col("seq").cast("string"))).alias("event_id"), "operation_id", F.when(F.col("event") == "complete", "COMMITTED").otherwise("FAILED").alias("kind"), "seq")


def request_rows(calls: DataFrame) -> DataFrame:
    """Log rows of calls (id, started_at, finished_at, ok, query, hits): made at the start, with a latency of 0 ms at least and their metadata as JSON."""
    latency = F.greatest(F.lit(0), F.unix_millis("finished_at") - F.unix_millis("started_at"))
    return calls.select("id", F.col("started_at").alias("created_at"), latency.alias("latency_ms"), F.when(F.col("ok"), "success").otherwise("failed").alias("status"), F.to_json(F.struct("query", "hits")).alias("metadata"))


def inference_summary(cases: DataFrame) -> DataFrame:
    """One row over evaluated cases (passed, required_matched, required_total, forbidden_matched, forbidden_total, facts, max_facts, critical, compliant,
    error); a share of nothing is 1."""
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    none = F.col("max_facts") == 0
    total = cases.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.sum("required_matched").alias("rm"), F.sum("required_total").alias("rt"), F.sum("forbidden_matched").alias("fm"), F.sum("forbidden_total").alias("ft"),
        F.count_if(F.col("critical") & ((F.col("forbidden_matched") > 0) | (F.col("facts") > F.col("max_facts")))).alias("critical_leaks"), F.count_if("compliant").alias("compliant"),
        F.count_if(none).alias("none"), F.count_if(none & ~F.col("error") & (F.col("facts") == 0)).alias("none_right"), F.sum(F.greatest(F.lit(0), F.col("facts") - F.col("required_matched"))).alias("unwanted_facts"), F.count_if("error").alias("failed_cases"),
    )
    c = F.col
    return total.select("cases", share(c("passed"), c("cases")).alias("pass_rate"), share(c("rm"), c("rt")).alias("required_recall"), share(c("fm"), c("ft")).alias("leak_rate"), "critical_leaks", share(c("compliant"), c("cases")).alias("compliance"), share(c("none_right"), c("none")).alias("no_memory_accuracy"), "unwanted_facts", "failed_cases")


def trace_points(questions: DataFrame) -> DataFrame:
    """(lane, score, label) of traced questions (judge_label, selected, lists: map of lane to an array of id and score): 1 if the answer was right and
    the row was selected."""
    rows = questions.where("lists is not null").select("judge_label", "selected", F.explode("lists").alias("lane", "list")).select("lane", "judge_label", "selected", F.explode("list").alias("item"))
    return rows.select("lane", "item.score", ((F.col("judge_label") == "CORRECT") & F.array_contains("selected", F.col("item.id"))).cast("int").alias("label"))
