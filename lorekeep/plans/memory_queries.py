"""Registered queries over memories: reads, filters, state, beliefs, maintenance and the write path."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import beliefs, filters, graph, journal, listing, maintenance, state
from ..sources.views import cte, load
from .registry import register

NOW = dt.datetime(2024, 3, 1)
NOW_SQL = "timestamp '2024-03-01 00:00:00'"


def us(name: str):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(f"{name}_us")


def numbered(df: DataFrame, *order) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy("namespace_id").orderBy(*order)))


@register(f"{cte('memories')} select id, namespace_id, memory_type, row_number() over (partition by namespace_id order by created_at desc, id desc) as place, epoch_us(created_at) as created_at_us from memories where not forgotten")
def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every namespace's list in the order of the most recent."""
    rows = load(spark, sf_dir, "memories").where(filters.visible())
    return numbered(rows, *listing.order_by("recent")).select("id", "namespace_id", "memory_type", "place", us("created_at"))


@register(f"{cte('memories')} select id, namespace_id, row_number() over (partition by namespace_id order by importance desc, created_at desc, id desc) as by_importance, row_number() over (partition by namespace_id order by access_count desc, created_at desc, id desc) as by_accesses, row_number() over (partition by namespace_id order by last_accessed_at desc, created_at desc, id desc) as by_last_access from memories where not forgotten")
def list_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories").where(filters.visible())
    for name, sort in (("by_importance", "importance"), ("by_accesses", "most_accessed"), ("by_last_access", "last_accessed")):
        rows = numbered(rows, *listing.order_by(sort)).withColumnRenamed("place", name)
    return rows.select("id", "namespace_id", "by_importance", "by_accesses", "by_last_access")


@register(f"{cte('memories')} select id, epoch_us(created_at) as created_at_us from memories where not forgotten and (created_at < timestamp '2024-01-01 05:00:00' or (created_at = timestamp '2024-01-01 05:00:00' and id < 'm0000300')) order by created_at desc, id desc limit 100")
def list_page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = listing.encode_cursor(dt.datetime(2024, 1, 1, 5), "m0000300")
    return listing.listed(load(spark, sf_dir, "memories"), cursor=cursor, limit=100).select("id", us("created_at"))


@register(f"{cte('memories')} select namespace_id, memory_type, count(*) as n from memories where not forgotten and user_id = 'u3' group by namespace_id, memory_type")
def count_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.visible() & filters.scope_wildcard(user_id="u3", agent_id=None)).groupBy("namespace_id", "memory_type").agg(F.count("*").alias("n"))


@register(f"{cte('memories', 'mentions')} select id, memory_type, importance from memories where id in (select memory_id from mentions where entity_id = 'e3') and not forgotten")
def get_many_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "mentions").where("entity_id = 'e3'").select(F.col("memory_id").alias("id"))
    return listing.get_many(load(spark, sf_dir, "memories"), ids).where(filters.visible()).select("id", "memory_type", "importance")


TREE = {"and": [
    {"or": [{"field": "importance", "op": "gte", "value": 0.5}, {"field": "memory_type", "op": "in", "value": ["identity", "goal"]}]},
    {"not": {"field": "attribute", "op": "eq", "value": "pet"}},
    {"field": "event_date", "op": "lt", "value": "2023-10-01T00:00:00Z"},
    {"field": "content", "op": "icontains", "value": "THE"},
    {"field": "access_count", "op": "ne", "value": 2},
]}


@register(f"{cte('memories')} select id, importance, attribute from memories where not forgotten and (importance >= 0.5 or memory_type in ('identity', 'goal')) and not coalesce(attribute = 'pet', false) and event_date < timestamp '2023-10-01' and contains(lower(content), 'the') and access_count <> 2")
def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters.validate(TREE)
    return load(spark, sf_dir, "memories").where(filters.visible() & filters.compile_filter(TREE)).select("id", "importance", "attribute")


@register("select event_id, cast(props->>'$.k' as bigint) as k from events where cast(props->>'$.k' as bigint) >= 50 and event_type <> 'view' and not (user_id = 3 and props->>'$.missing' is not null)")
def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("metadata", F.parse_json("props")).where("event_type <> 'view'")
    tree = {"and": [{"field": "metadata.k", "op": "gte", "value": 50}, {"not": {"field": "metadata.missing", "op": "exists", "value": True}}]}
    filters.validate(tree)
    return rows.where(filters.compile_filter(tree)).select("event_id", F.try_variant_get("metadata", "$.k", "bigint").alias("k"))


@register(f"{cte('memories')} select id, epoch_us(event_date) as event_date_us from memories where not forgotten and memory_type = 'fact' and event_date between timestamp '2023-02-01' and timestamp '2023-08-31' and access_count > 0 and lower(attribute) = 'residence'")
def filter_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = filters.structural(memory_type="fact", event_date=(dt.datetime(2023, 2, 1), dt.datetime(2023, 8, 31)), accessed=True, attribute="Residence")
    return load(spark, sf_dir, "memories").where(filters.visible() & test).select("id", us("event_date"))


@register(f"{cte('memories')} select id, importance from memories where not forgotten and importance >= 0.8 order by importance desc, updated_at desc, id desc limit 20")
def important_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.seeds(load(spark, sf_dir, "memories")).select("id", "importance")


@register(f"{cte('memories')} select m.id, cast(m.access_count + coalesce(a.n, 0) as bigint) as access_count, epoch_us(greatest(m.last_accessed_at, a.at)) as last_accessed_at_us from memories m left join (select concat('m', lpad(cast(event_id % 500 as varchar), 7, '0')) as id, count(*) as n, max(ts) as at from events where event_type = 'view' group by 1) a on a.id = m.id")
def record_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").where("event_type = 'view'").select(F.concat(F.lit("m"), F.lpad((F.col("event_id") % 500).cast("string"), 7, "0")).alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return listing.record_access(load(spark, sf_dir, "memories"), log).select("id", "access_count", us("last_accessed_at"))


@register(f"{cte('memories', 'edges')}, n as (select id from memories where not forgotten order by created_at desc, id desc limit 200) select src, dst, relation, weight from edges where src in (select id from n) and dst in (select id from n)")
def graph_subview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.subgraph(load(spark, sf_dir, "memories"), load(spark, sf_dir, "edges"))[1]


@register(f"{cte('memories', 'edges')} select e.src, e.dst, e.relation from edges e join memories a on a.id = e.src join memories b on b.id = e.dst where a.namespace_id is distinct from b.namespace_id")
def cross_namespace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_scope(load(spark, sf_dir, "edges"), load(spark, sf_dir, "memories")).select("src", "dst", "relation")


@register(f"{cte('memories')} select episode_id, min(namespace_id) as namespace_id, count(distinct namespace_id) as namespaces, count(*) as memories from memories where episode_id is not null group by episode_id having count(distinct namespace_id) >= 1")
def episode_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories").where("episode_id is not null")
    return rows.groupBy("episode_id").agg(F.min("namespace_id").alias("namespace_id"), F.count_distinct("namespace_id").alias("namespaces"), F.count("*").alias("memories"))


_SLOTS = """, b as (select *, lower(trim(subject)) as subject_key, lower(trim(attribute)) as attribute_key, lower(trim(value)) as v from state_obs),
i as (select *, case when v is not distinct from lag(v) over (partition by subject_key, attribute_key order by seq) and seq > min(seq) over (partition by subject_key, attribute_key) then 0 else 1 end as opens from b),
g as (select *, sum(opens) over (partition by subject_key, attribute_key order by seq) as island from i),
s as (select subject_key, attribute_key, island, arg_min(value, seq) as value, arg_min(valid_from, seq) as valid_from, min(seq) as seq, count(*) as sources from g group by all),
slots as (select *, lead(valid_from) over (partition by subject_key, attribute_key order by island) as valid_to from s)"""


@register(f"{cte('state_obs')}{_SLOTS} select subject_key, attribute_key, cast(island as bigint) as island, value, epoch_us(valid_from) as valid_from_us, epoch_us(valid_to) as valid_to_us, sources from slots")
def state_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.slots(load(spark, sf_dir, "state_obs")).select("subject_key", "attribute_key", "island", "value", us("valid_from"), us("valid_to"), F.size("sources").cast("long").alias("sources"))


@register(f"{cte('state_obs')}{_SLOTS} select subject_key, attribute_key, value, epoch_us(valid_from) as valid_from_us from slots where valid_to is null")
def state_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current(state.slots(load(spark, sf_dir, "state_obs"))).select("subject_key", "attribute_key", "value", us("valid_from"))


@register(f"{cte('state_obs')}{_SLOTS}, t as (select *, row_number() over (partition by subject_key, attribute_key order by valid_from, seq) as n from slots where valid_from <= (select min(ts) + interval '2' day from events) and (valid_to is null or (select min(ts) + interval '2' day from events) < valid_to)) select subject_key, attribute_key, value from t where n = 1")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = load(spark, sf_dir, "events").agg((F.min("ts") + F.expr("interval 2 day")).alias("at")).first()["at"]
    return state.as_of(state.slots(load(spark, sf_dir, "state_obs")), F.lit(at)).select("subject_key", "attribute_key", "value")


@register(f"{cte('state_obs')} select lower(subject) as subject_key, lower(attribute) as attribute_key, lower(value) as value_norm, min(seq) as seq, count(distinct source_id) as sources from state_obs group by 1, 2, 3")
def state_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.multi_slots(load(spark, sf_dir, "state_obs")).select("subject_key", "attribute_key", "value_norm", "seq", F.size("sources").cast("long").alias("sources"))


@register(f"{cte('memories')}, m as (select *, created_at as valid_from from memories where subject is not null and attribute is not null) select id, (coalesce(valid_from, event_date, created_at) <= {NOW_SQL} and (valid_to is null or {NOW_SQL} < valid_to)) as valid, row_number() over (partition by lower(subject), lower(attribute) order by coalesce(event_date, valid_from, created_at), id) as place from m")
def belief_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories").withColumn("valid_from", F.col("created_at"))
    return state.belief_at(rows, F.lit(NOW)).select("id", "valid", "place")


_AT = "(select max(ts) from events)"
_BELIEFS = f"""{cte('evidence')}, act as (select * from evidence where valid_from <= {_AT} and (valid_to is null or {_AT} < valid_to)),
torn as (select subject, attribute, evidence_key from act group by all having count(distinct value_key) > 1),
ok as (select act.* from act anti join torn on act.subject = torn.subject and act.attribute = torn.attribute and act.evidence_key = torn.evidence_key),
once as (select subject, attribute, value_key, evidence_key, max(weight) as weight, arg_min(context_id, (observed_at, id)) as context_id, min(observed_at) as first_observed from ok group by all),
c as (select subject, attribute, value_key, round(sum(weight), 9) as score, count(*) as evidence_count, count(distinct context_id) as context_count, min(first_observed) as first_observed from once group by all),
k as (select *, score / sum(score) over (partition by subject, attribute) as support,
  row_number() over (partition by subject, attribute order by round(score, 9) desc, evidence_count desc, first_observed, value_key) as rank from c),
l as (select *, round(score - coalesce(lead(score) over (partition by subject, attribute order by rank), 0.0), 9) as lead from k),
r as (select *, concat_ws(',', case when evidence_count < 3 then 'low_evidence' end, case when context_count < 3 then 'low_contexts' end, case when support < 0.6 then 'low_support' end, case when lead < 1 then 'low_lead' end) as reasons from l),
v as (select *, rank = 1 and reasons = '' as wins from r)
"""


@register(_BELIEFS + "select subject, attribute, value_key, round(score, 6) as score, evidence_count, context_count, round(support, 6) as support, rank, reasons, case when wins then 'supported' when max(wins) over (partition by subject, attribute) then 'superseded' else 'contested' end as status from v")
def belief_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = load(spark, sf_dir, "evidence")
    at = evidence.agg(F.max("observed_at").alias("at")).first()["at"]
    rows = beliefs.view(evidence, F.lit(at), mode="audit")
    return rows.select("subject", "attribute", "value_key", F.round("score", 6).alias("score"), "evidence_count", "context_count", F.round("support", 6).alias("support"), "rank", "reasons", "status")


@register(f"{cte('evidence')} select subject, attribute, evidence_key, count(distinct value_key) as n_values from evidence group by all having count(distinct value_key) > 1")
def belief_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "evidence").groupBy("subject", "attribute", "evidence_key").agg(F.count_distinct("value_key").alias("n_values")).where("n_values > 1")


@register(f"{cte('memories')}, d as (select *, (epoch_us({NOW_SQL}) - epoch_us(updated_at)) / 86400000000.0 as aged, (epoch_us({NOW_SQL}) - epoch_us(last_accessed_at)) / 86400000000.0 as idle from memories), f as (select *, case when memory_type = 'identity' then importance else least(greatest(importance * (1 - least(0.05 * aged, 0.5)) * case when idle < 7 then 1.1 when idle > 30 then 0.9 else 1.0 end, 0.0), 1.0) end as fresh from d) select id, round(case when abs(fresh - importance) >= 0.01 then fresh else importance end, 6) as decayed, abs(fresh - importance) >= 0.01 as written from f")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.decay(load(spark, sf_dir, "memories"), F.lit(NOW)).select("id", F.round("decayed", 6).alias("decayed"), "written")


@register(f"{cte('memories')} select id, memory_type, importance from memories where importance < 0.1 and created_at < {NOW_SQL} - interval '30' day and memory_type <> 'identity'")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(maintenance.prunable(F.lit(NOW))).select("id", "memory_type", "importance")


@register(f"{cte('memories')}, r as (select *, last_accessed_at >= {NOW_SQL} - interval '3' day as live from memories) select id, not live or sum(case when live then 1 else 0 end) over (partition by namespace_id order by last_accessed_at desc, id rows between unbounded preceding and current row) > 64 as demoted from r")
def demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.demote(load(spark, sf_dir, "memories"), F.lit(NOW)).select("id", "demoted")


@register(f"{cte('edges')}, h as (select least(src, dst) as a, greatest(src, dst) as b, arg_max(weight, (src, dst, relation)) as w from edges group by 1, 2), q as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where relation = 'updates' union select distinct 'm0000000' as a, dst as b from edges where relation = 'part_of' and dst > 'm0000000') select q.a, q.b, round(case when w is null then 0.1 else least(0.95, w + 0.1 * (0.95 - w)) end, 6) as weight, w is null as created from q left join h on h.a = q.a and h.b = q.b")
def reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "edges")
    pairs = edges.where("relation = 'updates'").select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.where("relation = 'part_of' and dst > 'm0000000'").select(F.lit("m0000000"), "dst"))
    return maintenance.reinforce(edges, pairs).withColumn("weight", F.round("weight", 6))


@register(f"{cte('memories')}, r as (select id as src, lag(id, k.k) over (partition by k.k, lower(subject), lower(attribute) order by created_at, id) as dst from memories, (values (1), (2), (3), (4)) k(k) where subject is not null and attribute is not null) select src, dst, 'same_slot' as relation, 0.95::double as weight from r where dst is not null")
def same_slot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.typed_edges(load(spark, sf_dir, "memories"), ["subject", "attribute"], "same_slot", 0.95)


@register(f"{cte('edges', 'mentions')}, m as (select memory_id as loser, max(memory_id) over (partition by entity_id) as winner from mentions where entity_id in ('e1')), x as (select coalesce(a.winner, e.src) as src, coalesce(b.winner, e.dst) as dst, relation, weight from edges e left join (select * from m where winner <> loser) a on a.loser = e.src left join (select * from m where winner <> loser) b on b.loser = e.dst) select src, dst, relation, max(weight) as weight from x where src <> dst group by all")
def merge_rewiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = load(spark, sf_dir, "mentions").where("entity_id = 'e1'").select(F.max("memory_id").over(Window.partitionBy("entity_id")).alias("winner"), F.col("memory_id").alias("loser")).where("winner <> loser")
    return maintenance.rewire(load(spark, sf_dir, "edges"), m)


@register("select event_id, case when row_number() over w = 1 then 'accepted' when cast(floor(value) as bigint) % 2 = first_value(cast(floor(value) as bigint) % 2) over w then 'replay' else 'conflict' end as outcome from events window w as (partition by user_id % 3, event_id % 97 order by event_id)")
def idempotent_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("namespace_id"), (F.col("event_id") % 97).alias("idempotency_key"), (F.floor("value").cast("long") % 2).alias("request_hash"), F.col("event_id").alias("seq"))
    return journal.claims(ops).select("event_id", "outcome")


_LOG = "(select concat('m', lpad(cast(event_id % 700 as varchar), 7, '0')) as id, event_id as seq, case event_type when 'error' then 'delete' else 'update' end as op, value from events)"


@register(f"{cte('memories')}, lg as {_LOG}, u as (select id, arg_max(value, seq) as v, max(seq) as s from lg where op = 'update' group by id), g as (select id, max(seq) as s from lg where op = 'delete' group by id) select m.id, round(coalesce(u.v, m.importance), 6) as importance from memories m left join u on u.id = m.id left join g on g.id = m.id where g.s is null or u.s > g.s")
def fold_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.lpad((F.col("event_id") % 700).cast("string"), 7, "0")).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.col("value").alias("importance"))
    return journal.fold(load(spark, sf_dir, "memories"), log, ["importance"]).select("id", F.round("importance", 6).alias("importance"))


@register("select event_id, case when event_id % 5 + 1 >= 5 then 'dead' else 'retry' end as status, case when event_id % 5 + 1 < 5 then epoch_us(ts) + cast(least(60 * pow(2, event_id % 5), 3600) * 1000000 as bigint) end as next_attempt_at_us from events where event_type = 'error'")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 5 + 1).alias("attempts"), F.lit("processing").alias("status"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.col("ts").cast("timestamp").alias("now"))
    return journal.after_failure(tasks, F.col("now")).select("event_id", "status", us("next_attempt_at"))


@register("select concat('m', cast(event_id % 300 as varchar)) as memory_id, arg_max(case when event_type = 'view' then null else event_type end, event_id) filter (where true) as last_type, arg_max_null(case when event_type = 'view' then null else event_type end, event_id) as feedback from events group by 1 having arg_max_null(case when event_type = 'view' then null else event_type end, event_id) is not null")
def feedback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 300).cast("string")).alias("memory_id"), F.lit("FEEDBACK").alias("event"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("new_value"), F.col("event_id").alias("created_at"), F.col("event_id").alias("id"))
    return journal.feedback(log).select("memory_id", F.col("feedback").alias("last_type"), "feedback")


@register("select conv_id, turn, role, text from conversations where length(trim(text)) > 0")
def add_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.add_verbatim(load(spark, sf_dir, "conversations"))


@register(f"{cte('memories')} select id, case when doc % 3 = 0 then 'ok' else 'conflict' end as outcome from (select id, cast(substr(id, 2) as bigint) as doc from memories)")
def version_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "memories")
    n = F.substring("id", 2, 7).cast("long")
    asked = m.select("id", F.when(n % 3 == 0, F.col("updated_at")).otherwise(F.col("updated_at") + F.expr("interval 1 second")).alias("version"))
    return journal.version_check(asked, m).select("id", "outcome")


@register(f"{cte('memories')} select id, case when cast(substr(id, 2) as bigint) % 10 = 1 then 'missing' else 'stale' end as problem from memories where not forgotten and cast(substr(id, 2) as bigint) % 10 in (1, 2)")
def projection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "memories")
    n = F.substring("id", 2, 7).cast("long") % 10
    vectors = m.where((n != 1) & filters.visible()).select("id", F.when(n == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return journal.verify_projection(m, vectors)


@register(f"{cte('memories')} select id, case memory_type when 'identity' then 1.0 when 'goal' then 0.9 when 'decision' then 0.8 when 'todo' then 0.8 when 'preference' then 0.7 when 'fact' then 0.6 when 'event' then 0.4 else 0.3 end::double as importance from memories")
def default_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories").select("id", F.col("memory_type").alias("call_type"), F.lit(None).cast("string").alias("extracted_type"), F.lit(None).cast("double").alias("importance"))
    return journal.with_defaults(rows).select("id", "importance")


@register("select doc_id, greatest(1, cast(ceil(strlen(text) / 8192.0) as bigint)) as credits, len(list_filter(string_split_regex(lower(text), '[^a-z0-9一-鿿]+'), lambda t: length(t) > 1)) as index_terms, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", S.credit_units(t).alias("credits"), F.size(S.index_terms(t)).cast("long").alias("index_terms"), S.token_estimate(t).alias("tokens"))
