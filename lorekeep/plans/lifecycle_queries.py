"""Registered queries of purges, promotion, merges, operations, batches and evaluation tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, lifecycle, maintenance, retrieval
from ..operators.filters import visible
from ..sources.views import cte, load
from .registry import register
from .search_queries import _Q, _SAID, _VECTOR, _WHEN, queries_of
from .sql import FNV, uuid

NOW = dt.datetime(2024, 1, 20, 12, 30)
NOW_SQL = "timestamp '2024-01-20 12:30:00'"


def _n(column: str = "id"):
    return F.substring(column, 2, 7).cast("long")


def _us(name: str):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(f"{name}_us")


@register(f"{cte('memories')}, e as (select namespace_id, episode_id, epoch_us(min(created_at)) as created_us, count(*) as rows from memories where episode_id is not null group by all), r as (select *, row_number() over (partition by namespace_id order by created_us desc, episode_id desc) as place from e) select * from r where place > 2 and place <= 7")
def episode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "memories").where("episode_id is not null").groupBy("namespace_id", "episode_id").agg(F.unix_micros(F.min("created_at").cast("timestamp")).alias("created_us"), F.count("*").alias("rows"))
    return lifecycle.page_of(e, ["namespace_id"], [F.desc("created_us"), F.desc("episode_id")], 2, 5)


@register("with n as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from labels) select doc_id from n where i % greatest(1, n // 37) = 0 and i < greatest(1, n // 37) * 37")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stride_sample(load(spark, sf_dir, "labels").select("doc_id"), 37, "doc_id")


_GONE = "g as (select id from memories where cast(substr(id, 2) as bigint) % 20 = 0)"


@register(f"{cte('memories', 'edges', 'mentions')}, {_GONE} select 'memory' as kind, id as a, '' as b, namespace_id as c from memories where id not in (select id from g) union all select 'edge', src, dst, relation from edges where src not in (select id from g) and dst not in (select id from g) union all select 'mention', memory_id, entity_id, '' from mentions where memory_id not in (select id from g)")
def deleted_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after rows of ids divisible by 20 are deleted, with edges at either end."""
    m = load(spark, sf_dir, "memories")
    left = lifecycle.without(m, load(spark, sf_dir, "edges"), load(spark, sf_dir, "mentions"), m.where(_n() % 20 == 0))
    none = F.lit("")
    rows = left["memories"].select(F.lit("memory").alias("kind"), F.col("id").alias("a"), none.alias("b"), F.col("namespace_id").alias("c"))
    rows = rows.unionByName(left["edges"].select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("c")))
    return rows.unionByName(left["mentions"].select(F.lit("mention").alias("kind"), F.col("memory_id").alias("a"), F.col("entity_id").alias("b"), none.alias("c")))


@register(f"{cte('memories', 'edges', 'mentions')}, g as (select id from memories where namespace_id = 'ns1') select 'memories' as name, count(*) as rows from memories where namespace_id <> 'ns1' union all select 'edges', count(*) from edges where src not in (select id from g) and dst not in (select id from g) union all select 'mentions', count(*) from mentions where memory_id not in (select id from g)")
def purged_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lifecycle.purged(load(spark, sf_dir, "memories"), load(spark, sf_dir, "edges"), load(spark, sf_dir, "mentions"), "ns1")
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register(f"{cte('memories')} select id, case when importance >= 0.9 then 'working' else 'long' end as tier, epoch_us(case when importance >= 0.9 then {NOW_SQL} else last_accessed_at end) as last_accessed_at_us from memories")
def promoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "memories")
    return lifecycle.promoted(m, m.where("importance >= 0.9"), F.lit(NOW)).select("id", "tier", _us("last_accessed_at"))


_PAIRS = "p as (select m.id as loser, w.id as winner, w.content || chr(10) || m.content as content from memories m join memories w on cast(substr(w.id, 2) as bigint) = cast(substr(m.id, 2) as bigint) - 1 where cast(substr(m.id, 2) as bigint) % 10 = 1)"


def _merge(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = load(spark, sf_dir, "memories")
    lost = m.where(_n() % 10 == 1).select(F.col("id").alias("loser"), F.col("content").alias("l"), (_n() - 1).alias("n"))
    # a winner's number is one below a loser's, so the texts of nine rows in ten need not move
    pairs = lost.join(m.where(_n() % 10 == 0).select(F.col("id").alias("winner"), F.col("content").alias("w"), _n().alias("n")), "n").select("winner", "loser", F.concat("w", F.lit("\n"), "l").alias("content"))
    return lifecycle.merged(m, load(spark, sf_dir, "edges"), load(spark, sf_dir, "mentions"), pairs)


@register(f"{cte('memories', 'edges')}, {_PAIRS}, e as (select coalesce(a.winner, src) as src, coalesce(b.winner, dst) as dst, relation, weight from edges left join p a on a.loser = src left join p b on b.loser = dst) select src, dst, relation, max(weight) as weight from (select * from e where src <> dst union all select winner, loser, 'updates', 1.0 from p) group by all")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)["edges"]


@register(f"{cte('memories', 'mentions')}, {_PAIRS} select distinct coalesce(p.winner, memory_id) as memory_id, entity_id from mentions left join p on p.loser = memory_id")
def merged_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)["mentions"]


@register(f"{cte('memories')}, {_PAIRS} select m.id, m.forgotten or b.loser is not null as forgotten, length(coalesce(a.content, m.content)) as chars from memories m left join p a on a.winner = m.id left join p b on b.loser = m.id")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)["memories"].select("id", "forgotten", F.length("content").cast("long").alias("chars"))


@register(f"{cte('memories', 'mentions')}, c as (select distinct f.memory_id as src, t.memory_id as dst, m.updated_at from mentions f join mentions t using (entity_id) join memories m on m.id = t.memory_id where cast(substr(f.memory_id, 2) as bigint) % 20 = 0 and f.memory_id <> t.memory_id), r as (select *, row_number() over (partition by src order by updated_at desc, dst) as place from c) select src, dst, 'same_entity' as relation, 0.6::double as weight from r where place <= 4")
def same_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "memories")
    return lifecycle.entity_edges(m.where(_n() % 20 == 0), m, load(spark, sf_dir, "mentions"))


@register(f"{cte('memories')}, r as (select id, lower(episode_id) as e, row_number() over (partition by lower(episode_id) order by created_at, id) as place from memories where episode_id is not null) select a.id as src, b.id as dst, 'same_episode' as relation, 0.45::double as weight from r a join r b on a.e = b.e and b.place between a.place - 4 and a.place - 1")
def same_episode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.typed_edges(load(spark, sf_dir, "memories"), ["episode_id"], "same_episode", 0.45)


@register(f"""{cte('memories')}, q as (select conv_id as qid, ' s' || (conv_id % 20) || ' and the s' || (conv_id * 3 % 20) || '!' as text from conversations where turn = 0), s as (select subject, count(*) as n from memories group by subject)
 select qid, m.id, round(max(least(0.12, 0.3 / sqrt(greatest(s.n, 1)))), 6) as boost from q join s on list_contains(string_split_regex(lower(q.text), '[^a-z0-9]+'), s.subject) join memories m on m.subject = s.subject group by all""")
def matched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the subjects that a question names."""
    n = F.col("conv_id")
    q = load(spark, sf_dir, "conversations").where("turn = 0").select(n.alias("qid"), F.concat(F.lit(" s"), (n % 20).cast("string"), F.lit(" and the s"), (n * 3 % 20).cast("string"), F.lit("!")).alias("text"))
    told = load(spark, sf_dir, "memories").select(F.col("id").alias("memory_id"), F.col("subject").alias("entity_id"))
    return lifecycle.entity_matches(q, told.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("name")).distinct(), told, digits=6)  # rounded for each entity, not pair by pair


@register(f"""{cte('evidence')}, l as (select evidence_key as k, min(observed_at) as at from evidence where cast(substr(evidence_key, 2) as int) % 4 = 1 group by 1)
 select e.id, epoch_us(least(e.valid_to, l.at)) as valid_to_us from evidence e left join l on l.k = e.evidence_key where cast(substr(e.evidence_key, 2) as int) % 4 <> 2 and e.context_id <> 'c5'""")
def evidence_after_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "evidence")
    n = F.substring("evidence_key", 2, 4).cast("int")
    log = e.where(n % 4 == 1).select(F.lit("invalidate").alias("op"), F.col("evidence_key").alias("key"), F.col("observed_at").alias("at"))
    log = log.unionByName(e.where(n % 4 == 2).select(F.lit("remove").alias("op"), F.col("evidence_key").alias("key"), F.col("observed_at").alias("at")).distinct())
    log = log.unionByName(spark.createDataFrame([("clear", "c5", None)], log.schema))
    return lifecycle.evidence_after(e, log, "evidence_key").select("id", _us("valid_to"))


def _slot_hash(k: int) -> str:
    return FNV.format(f"('{k}:' || subject || '|' || attribute)")


@register(f"""{cte('memories')}, s as (select distinct subject, attribute from memories where attribute is not null), h as (select *, {' || '.join(map(_slot_hash, range(4)))} as h from s)
 select subject, attribute, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || lower(to_hex(cast('0x' || substr(h, 17, 1) as bigint) % 4 + 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h""")
def slot_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = load(spark, sf_dir, "memories").where("attribute is not null").select("subject", "attribute").distinct()
    return slots.withColumn("id", lifecycle.slot_document_id(F.concat_ws("|", "subject", "attribute")))


@register(f"""{cte('requests')}, r as (select * from (values ('today', timestamp '2024-01-20 00:00:00'), ('last_7_days', {NOW_SQL} - interval '7' day), ('last_30_days', {NOW_SQL} - interval '30' day), ('last_90_days', {NOW_SQL} - interval '90' day), ('all', null)) t(name, start))
 select r.name, count(q.id) as requests from r left join requests q on q.created_at <= {NOW_SQL} and (r.start is null or q.created_at >= r.start) group by r.name""")
def range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests up to a moment in each named range, in one pass."""
    at, names = F.lit(NOW).cast("timestamp"), [*lifecycle.RANGE_DAYS, "all"]
    rows = load(spark, sf_dir, "requests").where(F.col("created_at") <= at)
    made = F.col("created_at").cast("timestamp")
    counts = rows.agg(*[F.count_if(F.coalesce(made >= lifecycle.range_start(n, at), F.lit(True))).alias(n) for n in names])
    return counts.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("name", "requests"))


_TASKS = "t as (select concat('w', cast(user_id % 3 as varchar)) as workspace_id, case event_type when 'click' then 'pending' when 'view' then 'success' when 'signup' then 'retry' when 'error' then case when user_id % 3 = 1 then 'dead' else 'success' end else 'processing' end as status, ts as created_at from events where ts <= timestamp '2024-01-20 12:30:00')"


@register(f"""{cte('usage')}, {_TASKS}, k as (select workspace_id, count(*) filter (status in ('pending', 'processing', 'retry')) as pending, count(*) filter (status = 'dead') as dead, min(created_at) filter (status in ('pending', 'processing', 'retry')) as o from t group by 1),
 w as (select workspace_id, count(*) as n from usage where kind = 'warning' and created_at >= {NOW_SQL} - interval '24' hour group by 1) select k.workspace_id, pending, dead, epoch_us(o) as oldest_pending_us, coalesce(w.n, 0) as warnings, dead > 0 or coalesce(o <= {NOW_SQL} - interval '5' minute, false) as degraded from k left join w using (workspace_id)""")
def task_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where(F.col("ts") <= F.lit(NOW))
    kind = F.col("event_type")
    status = F.when(kind == "click", "pending").when(kind == "view", "success").when(kind == "signup", "retry").when(kind == "error", F.when(F.col("user_id") % 3 == 1, "dead").otherwise("success")).otherwise("processing")
    tasks = e.select(F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workspace_id"), status.alias("status"), F.col("ts").alias("created_at"))
    rows = lifecycle.task_health(tasks, load(spark, sf_dir, "usage").where("kind = 'warning'"), F.lit(NOW))
    return rows.select("workspace_id", "pending", "dead", _us("oldest_pending"), "warnings", "degraded")


@register("with i as (select user_id % 50 as batch_id, case when event_id % 211 = 0 then 503 when event_id % 9 = 0 then 404 else 200 end as code from events) select batch_id, count(*) filter (code < 400) as succeeded, count(*) filter (code between 400 and 499) as failed, count(*) filter (code >= 500) > 0 as aborted, count(*) filter (code < 500) as processed from i group by 1")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    items = load(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("batch_id"), lifecycle.item_outcome(F.when(n % 211 == 0, 503).when(n % 9 == 0, 404).otherwise(200)).alias("outcome"))
    return lifecycle.batch_summary(items)


@register("""with i as (select doc_id % 11 as batch_id, case when doc_id % 11 = 3 then doc_id // 22 else doc_id end as id, octet_length(encode(coalesce(text, ''))) * case when doc_id % 11 = 5 then 50 else 1 end as bytes from documents),
 g as (select batch_id, id, count(*) as n, sum(bytes) as bytes from i group by all), b as (select batch_id, sum(n)::bigint as items, sum(bytes)::bigint as bytes, max(n) as most from g group by 1)
 select batch_id, items, bytes, ceil(items / 20)::bigint as steps, case when items > 1000 then 'too many items' when bytes > 750000 then 'too large' when most > 1 then 'repeated id' end as reason from b""")
def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.when(d % 11 == 5, 50).otherwise(1)
    items = load(spark, sf_dir, "documents").select((d % 11).alias("batch_id"), F.when(d % 11 == 3, F.expr("doc_id div 22")).otherwise(d).alias("id"), size.alias("bytes"))
    return lifecycle.batch_checks(items)


@register(f"""with c as (select event_id, 'ns' || (user_id % 2) as n, 'k' || (event_id // 3) as k, event_id % 3 as p from events) select event_id, {uuid("n || chr(0) || k || chr(0) || p")} as memory_id from c""")
def frozen_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    commands = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("ns"), (F.col("user_id") % 2).cast("string")).alias("namespace_id"), F.concat(F.lit("k"), F.expr("event_id div 3").cast("string")).alias("idempotency_key"), (e % 3).alias("position"))
    return lifecycle.frozen_plan(commands).select("event_id", "memory_id")


_LOG = "l as (select user_id as operation_id, event_id as seq, case event_type when 'view' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'note' end as event, ts + interval '2' day as lease_until from events)"


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "view", "claim").when(kind == "purchase", "complete").when(kind == "error", "fail").otherwise("note")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("operation_id"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("ts") + F.expr("interval 2 days")).alias("lease_until"))


@register(f"""with {_LOG}, s as (select operation_id, arg_max(event, seq) as event, arg_max(lease_until, seq) as lease, count(*) filter (event = 'claim') as attempts from l where event <> 'note' group by 1)
 select operation_id, attempts, case event when 'complete' then 'committed' when 'fail' then 'failed' else 'processing' end as status, event = 'fail' or (event = 'claim' and lease < {NOW_SQL}) as claimable from s""")
def operation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.operation_states(_operations(spark, sf_dir), F.lit(NOW)).drop("lease_until")


@register(f"""with {_LOG} select {uuid("operation_id || chr(0) || seq")} as event_id, operation_id, case event when 'complete' then 'COMMITTED' else 'FAILED' end as kind, seq from l where event in ('complete', 'fail')""")
def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.journal_rows(_operations(spark, sf_dir))


@register("""select event_id as id, epoch_us(ts) as created_at_us, greatest(0, (event_id % 7 - 2) * 1000)::bigint as latency_ms, case when event_type = 'error' then 'failed' else 'success' end as status,
 '{"query":"' || event_type || '","hits":' || (event_id % 5) || '}' as metadata from events""")
def request_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.expr("ts + make_dt_interval(0, 0, 0, cast(event_id % 7 - 2 as decimal(18,6)))").cast("timestamp")
    calls = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("started_at"), done.alias("finished_at"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("query"), (F.col("event_id") % 5).alias("hits"))
    return lifecycle.request_rows(calls).select("id", _us("created_at"), "latency_ms", "status", "metadata")


_CASES = "c as (select doc_id, quality = 1 as passed, doc_id % 4 as rm, doc_id % 4 + doc_id % 2 as rt, toxic as fm, 1 + doc_id % 2 as ft, doc_id % 5 as facts, doc_id % 3 as max_facts, doc_id % 7 = 0 as critical, doc_id % 5 <= doc_id % 3 as compliant, doc_id % 13 = 0 as error from labels)"


@register(f"""with {_CASES} select count(*) as cases, round(avg(passed::int), 6) as pass_rate, round(sum(rm) / sum(rt), 6) as required_recall, round(sum(fm) / sum(ft), 6) as leak_rate, count(*) filter (critical and (fm > 0 or facts > max_facts)) as critical_leaks,
 round(avg(compliant::int), 6) as compliance, round(count(*) filter (max_facts = 0 and not error and facts = 0) / count(*) filter (max_facts = 0), 6) as no_memory_accuracy, sum(greatest(0, facts - rm))::bigint as unwanted_facts, count(*) filter (error) as failed_cases from c""")
def inference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    cases = load(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed"), (d % 4).alias("required_matched"), (d % 4 + d % 2).alias("required_total"), F.col("toxic").alias("forbidden_matched"), (1 + d % 2).alias("forbidden_total"), (d % 5).alias("facts"), (d % 3).alias("max_facts"), (d % 7 == 0).alias("critical"), (d % 5 <= d % 3).alias("compliant"), (d % 13 == 0).alias("error"))
    out = lifecycle.inference_summary(cases)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in out.dtypes])


@register(f"{cte('memories')}, {_Q}, {_VECTOR} select 'vector' as lane, round(score, 6) as score, (cast(substr(qid, 2) as bigint) % 60 = 0 and rank <= 3)::int as label from vec where rank <= 10")
def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced hits of the vector lane; the first three of a query are selected, every third query is right."""
    hits = retrieval.vector_lane(queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible()), 10)
    items = F.collect_list(F.struct("id", F.round("score", 6).alias("score")))
    q = hits.groupBy("qid").agg(F.create_map(F.lit("vector"), items).alias("lists"), F.collect_list(F.when(F.col("rank") <= 3, F.col("id"))).alias("selected"))
    return lifecycle.trace_points(q.withColumn("judge_label", F.when(_n("qid") % 60 == 0, "CORRECT").otherwise("WRONG")))


@register(f"with t as (select conv_id, turn, {_SAID} as q from conversations), i as (select *, case {_WHEN} else 'multi_hop' end as intent from t) select conv_id, turn, case intent when 'single_fact' then 'precision' when 'temporal' then 'balanced' else 'recall' end as strategy from i")
def query_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.strategy(retrieval.intent(F.col("text"))).alias("strategy"))


@register("with e as (select event_id, ['T' || (event_id % 3), 't' || (event_id % 4)] as tags from events) select event_id from e where (list_contains(tags, 'T1') or len(list_filter(tags, lambda t: lower(t) = 't2')) > 0) and not (tags = ['T1', 't1']) and len(list_intersect(tags, ['t0', 't3'])) = 0")
def filter_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that is an array: membership, equality as a whole, and any of several."""
    e = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", F.parse_json(F.to_json(F.struct(F.array(F.concat(F.lit("T"), (e % 3).cast("string")), F.concat(F.lit("t"), (e % 4).cast("string"))).alias("tags")))).alias("metadata"))
    tags = lambda op, value: {"field": "metadata.tags", "op": op, "value": value}
    tree = {"and": [{"or": [tags("contains", "T1"), tags("icontains", "T2")]}, {"not": tags("eq", ["T1", "t1"])}, tags("nin", ["t0", "t3"])]}
    filters.validate(tree)
    return rows.where(filters.compile_filter(tree)).select("event_id")
