"""Registered queries of write jobs, second rounds of retrieval, summaries and evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import analytics, beliefs, documents, evaluation, fusion, journal, maintenance, retrieval, state
from ..operators.filters import visible
from ..scratch import kept
from ..sources.views import cte, load
from . import sql
from .memory_queries import _SLOTS
from .registry import register
from .search_queries import _BM25, _Q, _VECTOR, queries_of

SINCE = dt.datetime(2024, 1, 20)


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A batch of rows (ids divisible by 20) and all visible rows."""
    rows = load(spark, sf_dir, "memories").where(visible())
    return rows.where(F.substring("id", 2, 7).cast("long") % 20 == 0), rows


_COS = "round(list_cosine_similarity(cast(m.embedding as double[]), cast(q.embedding as double[])), 9)"
_BATCH = "q as (select * from memories where cast(substr(id, 2) as bigint) % 20 = 0 and not forgotten)"


@register(f"""{cte('memories')}, {_BATCH}, p as (select q.id as qid, m.id, {_COS} as score from q join memories m on m.namespace_id = q.namespace_id and (m.created_at, m.id) < (q.created_at, q.id)
 where not m.forgotten and m.embedding is not null and q.embedding is not null), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from p where score >= 0.2)
 select qid, id, round(score, 6) as score, rank from r where rank <= 3""")
def auto_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a batch to earlier rows; 0.2 in place of 0.6, which hardly any two of these vectors reach."""
    batch, rows = _batch(spark, sf_dir)
    return retrieval.associations(batch, rows, least=0.2).withColumn("score", F.round("score", 6))


@register(f"""{cte('memories')}, {_BATCH}, p as (select q.id as qid, m.id, {_COS} as score from q join memories m on m.namespace_id = q.namespace_id and m.id <> q.id
 where not m.forgotten and m.embedding is not null and q.embedding is not null), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from p where score >= 0.2)
 select qid, id, round(score, 6) as score from r where rank = 1""")
def synonym_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, rows = _batch(spark, sf_dir)
    return retrieval.synonyms(batch, rows, least=0.2).withColumn("score", F.round("score", 6))


@register(f"""{cte('memories')}, {_Q}, {_VECTOR}, e as (select episode_id, min(id) as gist_id, (40 + min(importance) * 100)::bigint as gist_tokens from memories where episode_id is not null group by episode_id),
 r as (select v.qid, v.id, v.rank, m.episode_id, ceil(length(m.content) / 4)::bigint as tokens from vec v join memories m using (id) where v.rank <= 10),
 j as (select r.*, gist_id, coalesce(r.episode_id is not null and gist_id is not null and count(*) over (partition by qid, r.episode_id) >= 2 and gist_tokens < sum(tokens) over (partition by qid, r.episode_id), false) as swap, min(rank) over (partition by qid, r.episode_id) as first from r left join e on e.episode_id = r.episode_id)
 select qid, case when swap then gist_id else id end as id, row_number() over (partition by qid order by rank, id) as rank, swap as is_gist from j where not swap or rank = first""")
def gist_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories")
    hits = retrieval.vector_lane(queries_of(spark, sf_dir), rows.where(visible()), 10)
    tokens = F.ceil(F.length("content") / 4)
    gists = rows.where("episode_id is not null").groupBy("episode_id").agg(F.min("id").alias("gist_id"), (40 + F.min("importance") * 100).cast("decimal(20,0)").cast("long").alias("gist_tokens"))
    ready = hits.join(rows.select("id", "episode_id", tokens.alias("tokens")), "id")
    return fusion.follow_gists(ready, gists).select("qid", "id", "rank", "is_gist")


@register(f"""{cte('memories')}, {_Q}, {_VECTOR}, {_BM25}, f as (select qid, id, round(score, 6) as score, rank as place from vec where rank <= 9), n as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as place from (select qid, id, round(score, 6) as score from fts where rank <= 5) x where not exists (select 1 from f where f.qid = x.qid and f.id = x.id)),
 b as (select *, 1 as round from f union all select *, 2 from n where place <= 3), c as (select *, 9 - sum((round = 2)::int) over (partition by qid) as room from b)
 select qid, id, score, round, row_number() over (partition by qid order by round, place) as rank from c where round = 2 or place <= room""")
def deep_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second lane as the follow-up round of the first."""
    q, rows = queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible())
    first, more = retrieval.vector_lane(q, rows, 9), retrieval.bm25_lane(q, rows, 5)
    cut = lambda d: d.select("qid", "id", F.round("score", 6).alias("score"))
    return fusion.deepened(cut(first), cut(more), 9)


@register()
def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories and passages of documents for the benchmark texts."""
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    found = documents.search_documents(q, documents.chunks(load(spark, sf_dir, "documents"), "doc_id", "text"), reach=0, id_="doc_id")
    passages = found.select("qid", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "score")
    memories = retrieval.bm25_lane(q, load(spark, sf_dir, "memories").where(visible()), 5)
    return fusion.federated(memory=memories, document=retrieval.top(passages, 5)).withColumn("score", F.round("score", 6))


@register()
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One merge per row, the most important winners first; 0.35 in place of 0.95, which no two of these vectors reach."""
    rows = load(spark, sf_dir, "memories").where(visible())
    return maintenance.greedy_matching(maintenance.near_pairs(rows, 0.35), [-F.col("importance")]).select("winner", "loser")


@register(f"{cte('memories')} select namespace_id, count(*) as memories, count(distinct nullif(user_id, '')) + count(distinct nullif(agent_id, '')) + count(distinct nullif(run_id, '')) as entities from memories where not forgotten group by namespace_id")
def scope_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.scope_entity_counts(load(spark, sf_dir, "memories"))


@register(f"""{cte('memories')}, v as (select *, row_number() over (partition by namespace_id order by created_at desc, id desc) as a, row_number() over (partition by namespace_id, access_count > 0 order by last_accessed_at desc, created_at desc, id desc) as b from memories where not forgotten)
 select namespace_id, count(*) as total, count(*) filter (created_at >= timestamp '2024-01-20') as remembered, count(*) filter (access_count > 0 and last_accessed_at >= timestamp '2024-01-20') as recalled,
 list(id order by a) filter (a <= 3) as latest, list(id order by b) filter (b <= 3 and access_count > 0) as latest_recalled from v group by namespace_id""")
def recent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent_summary(load(spark, sf_dir, "memories"), F.lit(SINCE))


@register("""select event_id as id, case event_type when 'click' then 'PENDING' when 'view' then 'RUNNING' when 'signup' then 'RETRYING' when 'purchase' then 'SUCCEEDED' else 'FAILED' end as status,
 case when event_type = 'purchase' then case when event_id % 3 > 0 then 'STORED' else 'NO_MEMORY' end end as outcome, greatest(0, (event_id % 7 - 2) * 1000)::bigint as latency_ms from events""")
def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "pending", "view", "processing", "signup", "retry", "purchase", "success", "error", "dead")]), F.col("event_type"))
    done = F.expr("ts + make_dt_interval(0, 0, 0, cast(event_id % 7 - 2 as decimal(18,6)))")
    tasks = e.select(F.col("event_id").alias("id"), kind.alias("state"), (F.col("event_id") % 3).alias("stored"), F.col("ts").alias("started_at"), done.alias("completed_at"))
    return analytics.memory_events(tasks, journal.event_status(F.col("state")))


@register(f"""{cte('memories')}, {_Q}, {_VECTOR}, t as (select q.qid, m.id from q join memories m on m.id <> q.qid and m.episode_id = (select episode_id from memories x where x.id = q.qid))
 select qid, coalesce(bool_or(rank <= 10), false) as hit from t left join vec using (qid, id) group by qid""")
def hits_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query's first ten vector hits hold a row of its own episode."""
    rows = load(spark, sf_dir, "memories")
    hits = retrieval.vector_lane(queries_of(spark, sf_dir), rows.where(visible()), 10)
    hits = kept(hits, "hits")
    ids = rows.where("episode_id is not null").select("id", "episode_id")
    asked = ids.where(F.substring("id", 2, 7).cast("long") % 20 == 0).withColumnRenamed("id", "qid")
    # of a query's targets only those among its hits matter, and that it has one: an episode's rows are never paired
    ends = ids.groupBy("episode_id").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    some = asked.join(ends, "episode_id").where("qid <> least or qid <> most").select("qid", F.lit(None).cast("string").alias("id"))
    met = hits.select("qid", "id").where("qid <> id").join(ids, "id").join(asked, ["qid", "episode_id"]).select("qid", "id")
    return evaluation.hit_at_k(hits, met.unionByName(some))


_FLAT = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@register(f"""with c as (select conv_id as qid, string_agg(text, chr(10) order by turn) as context from conversations where turn < 4 and conv_id is not null group by conv_id), e as (select conv_id as qid, text from conversations)
 select qid, bool_and(coalesce(contains({_FLAT.format('context')}, {_FLAT.format('text')}), false)) as recalled, count(*) as evidence from e left join c using (qid) group by qid""")
def evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first four turns of a conversation, as its context, hold the text of all its turns."""
    c = load(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "qid")
    contexts = c.where("turn < 4 and qid is not null").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("context"))
    return evaluation.evidence_recall(contexts, c.select("qid", "text"))


@register("select conv_id, role as category, avg(case when role = 'event_ordering' then turn * 0.7 else trunc(turn * 0.7) end) as score, count(*) as items from (select conv_id, turn, case when role = 'user' then 'event_ordering' else role end as role from conversations) group by all")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return evaluation.rubric_scores(c.select("conv_id", F.when(F.col("role") == "user", "event_ordering").otherwise(F.col("role")).alias("category"), (F.col("turn") * 0.7).alias("score")), "conv_id")


@register("""with c as (select conv_id, turn, role, coalesce(text, '') as event from conversations), r as (select conv_id, event, row_number() over (partition by conv_id order by turn, event) as place from c),
 s as (select conv_id, event, row_number() over (partition by conv_id order by role, event) as place from c where turn <> 2),
 u as (select conv_id, event, x.place as x, y.place as y, x.n as lost, y.n as extra from (select conv_id, event, max(place) as place, count(*) as n from r group by all) x full join (select conv_id, event, max(place) as place, count(*) as n from s group by all) y using (conv_id, event)),
 n as (select conv_id, count(*) as n, count(*) filter (x is not null and y is not null) as same, coalesce(sum(lost) filter (y is null), 0) as lost, coalesce(sum(extra) filter (x is null), 0) as extra from u group by conv_id),
 k as (select conv_id, coalesce(x, n + 1) as x, coalesce(y, n + 1) as y from u join n using (conv_id)),
 t as (select a.conv_id, sum(sign(a.x - b.x) * sign(a.y - b.y)) as s, sum(abs(sign(a.x - b.x)))::double as nx, sum(abs(sign(a.y - b.y)))::double as ny from k a join k b using (conv_id) group by a.conv_id),
 m as (select conv_id, case when same + extra > 0 then same / (same + extra)::double else 0.0 end as p, case when same + lost > 0 then same / (same + lost)::double else 0.0 end as r, case when nx > 0 and ny > 0 then (s / sqrt(nx * ny) + 1) / 2 else 0.0 end as t from n join t using (conv_id)),
 f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f from m)
 select conv_id, round(p, 6)::double as precision, round(r, 6)::double as recall, round(f, 6)::double as f1, round(t, 6)::double as tau_norm, round(t * f, 6)::double as final from f""")
def event_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a conversation's texts by turn against that by role and text."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("event"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "event")))["event"].alias("reference"), F.array_sort(F.collect_list(F.when(F.col("turn") != 2, F.struct("role", "event"))))["event"].alias("system"))
    return evaluation.event_ordering(lists).select("conv_id", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1", "tau_norm", "final")])


@register()
def requirement_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of a conversation find a turn of their own that repeats a word of theirs."""
    from ..operators import matching

    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    links = c.join(c.withColumnRenamed("turn", "fact"), ["conv_id", "word"]).where("turn <> fact").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("requirement"), "fact").distinct()
    return matching.matched(links)


_SPLIT = r"'[^\p{L}\p{N}_]+'"


@register(rf"""with c as (select conv_id, turn, role, string_split_regex(lower(coalesce(text, '')), {_SPLIT}) as w from conversations),
 a as (select conv_id, turn, list_sort(list_distinct(list_filter(w, lambda t: length(t) >= 3)))[1:4] as any_text from c where role = 'user')
 select a.conv_id as case_id, a.turn as requirement, c.turn as fact from a join c on a.conv_id = c.conv_id and list_has_any(c.w, a.any_text) where c.role <> 'user'""")
def facts_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn asks for any of four of its words; the other turns of the conversation are the facts."""
    from ..operators import matching

    c = load(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 3)))
    none, list_ = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    wants = c.where("role = 'user'").withColumn("w", F.slice(words, 1, 4)).where("size(w) > 0").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("requirement"), list_.alias("all_text"), F.col("w").alias("any_text"), none.alias("subject"), none.alias("attribute"), list_.alias("memory_types"))
    facts = c.where("role <> 'user'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("fact"), "text", none.alias("subject"), none.alias("attribute"), F.col("role").alias("memory_type"))
    return matching.met_by(wants, facts)


@register()
def episode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.episode_chunks(load(spark, sf_dir, "conversations"), "conv_id", "turn", 400, 60)


_BARE = "list_distinct(list_filter(list_transform({}, lambda t: case when length(t) > 3 and t like '%s' then left(t, -1) else t end), lambda t: length(t) >= 2 and t not in (" + ", ".join(f"'{w}'" for w in documents.PROFILE_STOP_WORDS) + ")))"


@register(f"""with q as (select conv_id as qid, lower(text) as asked, {_BARE.format(sql.words('text'))} as terms from conversations where turn = 0 and text is not null),
 s as (select conv_id, 't' || lpad(turn::varchar, 3, '0') as id, lower(text) as low, {_BARE.format(sql.words("concat_ws(chr(10), role, text)"))} as held from conversations where text is not null),
 p as (select q.qid, s.id, round(len(list_intersect(q.terms, s.held))::double / len(q.terms) + case when contains(s.low, q.asked) then 0.25 else 0.0 end, 9) as score from q join s on s.conv_id = q.qid where len(q.terms) > 0),
 r as (select *, row_number() over (partition by qid order by score desc, id) as rank from p where score >= 0.01) select * from r where rank <= 3""")
def profile_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as sections of its profile; its first turn as the query."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    sections = c.select(F.col("conv_id").alias("profile_id"), F.format_string("t%03d", "turn").alias("id"), F.col("role").alias("title"), F.col("text").alias("body"))
    return documents.search_sections(c.where("turn = 0").select(F.col("conv_id").alias("qid"), F.col("conv_id").alias("profile_id"), "text"), sections)


@register()
def belief_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners in each of two contexts, with the global one behind them."""
    n = F.substring("id", 3, 12).cast("long")
    e = load(spark, sf_dir, "evidence").withColumn("applicability", F.when(n % 3 > 0, F.concat(F.lit("g"), (n % 2).cast("string"))))
    asked = e.select("subject", "attribute").distinct().withColumn("applicability", F.explode(F.array(F.lit("g0"), F.lit("g1"), F.lit("g2"))))
    policy = beliefs.Policy(support=0.3, lead=0.1)
    return beliefs.contextual_view(e.withColumn("evidence_key", F.col("id")), asked, F.lit(dt.datetime(2024, 1, 20)), policy)


@register(f"""{cte('state_obs')}{_SLOTS}, t as (select subject_key, attribute_key, 'Belief slot ' || subject_key || ' / ' || attribute_key || chr(10) || 'Current: ' || coalesce(max(value) filter (valid_to is null), 'unknown') || chr(10) || 'Timeline:' || chr(10)
 || string_agg(strftime(valid_from, '%Y-%m-%d') || ' - ' || coalesce(strftime(valid_to, '%Y-%m-%d'), 'now') || ' : ' || value, chr(10) order by valid_from, island) || chr(10) || 'Evidence: ' || count(*) as summary from slots group by subject_key, attribute_key)
 select subject_key, attribute_key, sha256(summary) as digest, length(summary) as chars from t""")
def slot_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.summary_text(state.slots(load(spark, sf_dir, "state_obs"))).select("subject_key", "attribute_key", F.sha2("summary", 256).alias("digest"), F.length("summary").alias("chars"))


@register()
def mapped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries moved by a map that takes each vector to the mean direction of its label's next row."""
    e = load(spark, sf_dir, "embeddings")
    pairs = e.alias("a").join(e.alias("b"), (F.col("b.vec_id") == F.col("a.vec_id") + 10) & (F.col("a.label") == F.col("b.label")))
    matrix = vectors.fit_query_map(pairs.select(F.col("a.vec_id").alias("id"), F.col("a.embedding").alias("query"), F.col("b.embedding").alias("memory")))
    return vectors.map_queries(e.where("vec_id % 20 = 0").select("vec_id", "embedding"), matrix).select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
