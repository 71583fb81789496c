"""Registered queries over request logs, usage, documents and evaluation runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics, documents, evaluation
from ..sources.views import cte, load
from .registry import register
from .sql import FNV, uuid


@register(f"{cte('memories')}, e as (select namespace_id, 'user' as type, user_id as entity_id, created_at, updated_at from memories where not forgotten union all select namespace_id, 'agent', agent_id, created_at, updated_at from memories where not forgotten union all select namespace_id, 'run', run_id, created_at, updated_at from memories where not forgotten) select namespace_id, type, entity_id, count(*) as memories, epoch_us(min(created_at)) as first_created_us, epoch_us(max(updated_at)) as last_updated_us from e where entity_id is not null and entity_id <> '' group by all")
def scope_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.scope_entities(load(spark, sf_dir, "memories"))
    return rows.select("namespace_id", "type", "entity_id", "memories", F.unix_micros("first_created").alias("first_created_us"), F.unix_micros("last_updated").alias("last_updated_us"))


@register(f"{cte('memories')} select namespace_id, count(*) as total_memories, count(distinct nullif(user_id, '')) + count(distinct nullif(agent_id, '')) + count(distinct nullif(run_id, '')) as total_entities from memories where not forgotten group by namespace_id")
def namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.namespace_stats(load(spark, sf_dir, "memories"))


@register(f"{cte('requests')} select workspace_id, count(*) as requests, sum((status = 'success')::int)::bigint as successes, floor(1000.0 * sum((status = 'success')::int) / count(*) + 0.5) / 10 as success_rate, cast(floor(avg(latency_ms) + 0.5) as bigint) as avg_latency_ms from requests group by workspace_id")
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.request_totals(load(spark, sf_dir, "requests"), "workspace_id")


@register(f"{cte('requests')} select workspace_id, strftime(created_at, '%Y-%m-%d') as day, count(*) as requests, sum((status = 'success')::int)::bigint as successes, floor(1000.0 * sum((status = 'success')::int) / count(*) + 0.5) / 10 as success_rate, cast(floor(avg(latency_ms) + 0.5) as bigint) as avg_latency_ms from requests group by all")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.request_totals(load(spark, sf_dir, "requests"), "workspace_id", analytics.day())


@register(f"{cte('requests')}, g as (select workspace_id, operation as name, count(*) as requests from requests group by all) select workspace_id, name, requests, cast(floor(100.0 * requests / sum(requests) over (partition by workspace_id) + 0.5) as bigint) as share, row_number() over (partition by workspace_id order by requests desc, name) as rank from g")
def top_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_shares(load(spark, sf_dir, "requests"), "operation")


@register(f"{cte('requests')}, g as (select workspace_id, coalesce(api_token_id, 'dashboard') as name, count(*) as requests from requests group by all) select workspace_id, name, requests, cast(floor(100.0 * requests / sum(requests) over (partition by workspace_id) + 0.5) as bigint) as share, row_number() over (partition by workspace_id order by requests desc, name) as rank from g")
def top_api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_shares(load(spark, sf_dir, "requests"), "api_token_id", "dashboard")


@register(f"{cte('requests')} select workspace_id, count(*) as requests, sum((operation in ('memories.add', 'documents.ingest'))::int)::bigint as additions, sum((operation in ('memories.search', 'memories.list'))::int)::bigint as retrievals, sum((status = 'failed')::int)::bigint as failures from requests group by workspace_id")
def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.request_summary(load(spark, sf_dir, "requests"))


@register(f"{cte('requests')}, r as (select *, row_number() over (partition by workspace_id order by created_at desc, id desc) as place, count(*) over (partition by workspace_id) as n from requests) select workspace_id, id, place, n > 200 as truncated from r where place <= 200")
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(load(spark, sf_dir, "requests")).select("workspace_id", "id", "place", "truncated")


_PRICED = f"""{cte('usage', 'prices')}, m as (select u.*, p.id as price_id, p.input_micros, p.output_micros, row_number() over (partition by u.id order by p.workspace_id nulls last, p.effective_at desc) as n
  from usage u left join prices p on p.model = u.model and p.effective_at <= u.created_at and (p.workspace_id is null or p.workspace_id = u.workspace_id)),
priced as (select *, cast(floor((input_tokens * input_micros + output_tokens * output_micros) / 1e6 + 0.5) as bigint) as cost_micros from m where n = 1)"""


@register(f"{_PRICED} select id, price_id, cost_micros from priced")
def usage_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.priced(load(spark, sf_dir, "usage"), load(spark, sf_dir, "prices")).select("id", "price_id", "cost_micros")


@register(f"{_PRICED} select workspace_id, count(*) as events, sum(case when kind = 'provider_usage' then input_tokens end)::bigint as input_tokens, sum(case when kind = 'provider_usage' then output_tokens end)::bigint as output_tokens, sum(case when kind = 'provider_usage' then cost_micros end)::bigint as cost_micros, sum((kind = 'provider_usage' and cost_micros is null)::int)::bigint as unpriced, sum((kind <> 'provider_usage')::int)::bigint as warnings, sum(retry_count)::bigint as retries, cast(quantile_disc(latency_ms, 0.5) as bigint) as p50, cast(quantile_disc(latency_ms, 0.95) as bigint) as p95 from priced group by workspace_id")
def observability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.observability(analytics.priced(load(spark, sf_dir, "usage"), load(spark, sf_dir, "prices")))


@register(f"{_PRICED} select model, kind, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(coalesce(cost_micros, 0))::bigint as cost_micros, sum((cost_micros is null)::int)::bigint as unpriced from priced group by model, kind")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.priced(load(spark, sf_dir, "usage"), load(spark, sf_dir, "prices"))
    return rows.groupBy("model", "kind").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum(F.coalesce("cost_micros", F.lit(0))).alias("cost_micros"), F.count_if(F.col("cost_micros").isNull()).alias("unpriced"))


@register(f"{cte('requests')}, w as (select (epoch_ms(timestamp '2024-01-31') - epoch_ms(timestamp '2024-01-01')) / 30.0 as width), c as (select least(floor((epoch_ms(created_at) - epoch_ms(timestamp '2024-01-01')) / (select width from w)), 29)::int as bucket, status, count(*) as n from requests where created_at between timestamp '2024-01-01' and timestamp '2024-01-31' group by all), g as (select status, unnest(generate_series(0, 29))::int as bucket from (select distinct status from requests)) select g.bucket, g.status, coalesce(c.n, 0) as n from g left join c on c.bucket = g.bucket and c.status = g.status")
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    return analytics.time_buckets(load(spark, sf_dir, "requests"), F.lit(start), F.lit(end), analytics.bucket_count(30), "status")


@register(f"{cte('requests')} select status, count(*) as n, epoch_us(min(created_at)) as oldest_us from requests group by status")
def status_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_counts(load(spark, sf_dir, "requests")).select("status", "n", F.unix_micros(F.col("oldest").cast("timestamp")).alias("oldest_us"))


@register(f"{cte('requests', 'memories')}, f as (select 'requests' as feed, cast(id as varchar) as id, created_at from requests union all select 'memories', id, created_at from memories) select feed, id, epoch_us(created_at) as created_at_us from f order by created_at desc, id desc, feed limit 100")
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = {n: load(spark, sf_dir, n).withColumn("created_at", F.col("created_at").cast("timestamp")) for n in ("requests", "memories")}
    return analytics.activity(feeds).select("feed", "id", F.unix_micros("created_at").alias("created_at_us"))


@register(f"{cte('paired')} select category, count(*) as n, avg(a_correct::double) as accuracy from paired group by category")
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(load(spark, sf_dir, "paired"), "category", "a_correct")


@register(f"""{cte('paired')}, c as (select category, count(*) as n, sum((a_correct = 1 and b_correct <> 1)::int)::bigint as a_only, sum((a_correct <> 1 and b_correct = 1)::int)::bigint as b_only, avg((a_correct - b_correct)::double) as delta from paired group by category),
t as (select category, sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))) as p from (select *, unnest(generate_series(0, least(a_only, b_only))) as i from c) group by category)
select c.category, n, a_only, b_only, round(delta, 6) as delta, round(case when a_only + b_only = 0 then 1.0 else least(1.0, 2 * p) end, 6) as p_value from c join t on t.category = c.category""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mcnemar(load(spark, sf_dir, "paired"), "category").withColumns({"delta": F.round("delta", 6), "p_value": F.round("p_value", 6)})


@register()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 10,000 resamples per category, in one sequence of draws."""
    return evaluation.bootstrap_exact(load(spark, sf_dir, "paired"), "category")


@register(f"{cte('paired')}, x as (select category, a_correct as x, b_correct + item_id % 3 as y, count(*) as n from paired group by all), p as (select a.category, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) as s, sum(case when a.x = b.x then 0 else a.n * b.n end) as nx, sum(case when a.y = b.y then 0 else a.n * b.n end) as ny from x a join x b on a.category = b.category and (a.x, a.y) < (b.x, b.y) group by all) select category, round(case when nx > 0 and ny > 0 then s / sqrt(nx::double * ny) end, 6) as tau_b from p")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "paired").select("category", F.col("a_correct").alias("x"), (F.col("b_correct") + F.col("item_id") % 3).alias("y"))
    return evaluation.kendall_tau_b(rows, "category").withColumn("tau_b", F.round("tau_b", 6))


@register("""with t as (select conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0) as w from conversations),
p as (select a.conv_id, a.turn, a.w as p, b.w as g from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
o as (select conv_id, turn, len(p) as np, len(g) as ng, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) as same from p)
select conv_id, turn, round(case when np = 0 or ng = 0 then (np = ng)::int::double else 2.0 * same / (np + ng) end, 6) as f1, round(case when np = 0 or ng = 0 then 0.0 else (case when np >= ng then 1.0 else exp(1 - ng / np::double) end) * same / np end, 6) as bleu1 from o""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 and BLEU-1 of each turn against the next one."""
    a = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("p"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("g"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.token_f1(F.col("p"), F.col("g")), 6).alias("f1"), F.round(S.bleu1(F.col("p"), F.col("g")), 6).alias("bleu1"))


@register("with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as place from documents) select doc_id, source, place from r where place <= 3")
def stratified_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fusion import take_per_group

    return take_per_group(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 3)


@register("select conv_id, cast(floor((row_number() over (partition by conv_id order by turn) - 1) / 4) as bigint) as chunk, turn, role from conversations")
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns to a chunk."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return load(spark, sf_dir, "conversations").select("conv_id", F.floor((n - 1) / 4).alias("chunk"), "turn", "role")


@register()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunks(load(spark, sf_dir, "documents"), "doc_id", "text")


_VERSIONS = """with v as (select case when doc_id % 2 = 0 then 'ns0' else 'ns1' end as namespace_id, concat(source, '/', cast(doc_id % 10 as varchar)) as source_key, text as content, lang as metadata, timestamp '2024-01-01' + interval '1' minute * doc_id as updated_at from documents),
h as (select *, sha256('{"contentHash":"' || sha256(content) || '","metadata":"' || metadata || '"}') as version_hash from v),
f as (select * from (select *, row_number() over (partition by namespace_id, source_key, version_hash order by updated_at) as n from h) where n = 1)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return documents.with_versions(d.select(F.when(F.col("doc_id") % 2 == 0, "ns0").otherwise("ns1").alias("namespace_id"), F.concat_ws("/", "source", (F.col("doc_id") % 10).cast("string")).alias("source_key"), F.col("text").alias("content"), F.col("lang").alias("metadata"), (F.lit(dt.datetime(2024, 1, 1)) + F.expr("interval 1 minute") * F.col("doc_id")).alias("updated_at")))


@register(_VERSIONS + " select namespace_id, source_key, version_hash, epoch_us(updated_at) as updated_at_us from f")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("namespace_id", "source_key", "version_hash", F.unix_micros("updated_at").alias("updated_at_us"))


@register(_VERSIONS + " select namespace_id, source_key, arg_max(version_hash, updated_at) as version_hash, count(*) as versions from f group by all")
def document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    current = documents.current_documents(v).select("namespace_id", "source_key", "version_hash")
    return current.join(v.groupBy("namespace_id", "source_key").agg(F.count("*").alias("versions")), ["namespace_id", "source_key"])


@register()
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents for every benchmark text."""
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    c = documents.chunks(load(spark, sf_dir, "documents"), "doc_id", "text")
    return documents.search_documents(q, c, id_="doc_id").select("qid", "doc_id", "hit_index", "chunk_index", "score")


# conversations as documents, their turns as passages; three conversations in a row are versions of one source
_PASSAGES = """with n as (select count(*) as n from embeddings), c as (select conv_id as document_id, turn as chunk_index, coalesce(text, '') as content, (conv_id // 3) % 2 as space, e.embedding from conversations, n left join embeddings e on e.vec_id = (conv_id * 31 + turn) % n.n),
 head as (select max(conv_id) as document_id from conversations group by conv_id // 3)"""


@register(f"""{_PASSAGES}, k as (select *, concat(cast(document_id as varchar), '#', lpad(cast(chunk_index as varchar), 6, '0')) as id from c where space = 0), q as (select document_id as qid, content as text, embedding from c where chunk_index = 0 and document_id % 20 = 0),
 tok as (select id, list_filter(string_split_regex(lower(content), '[^a-z0-9一-鿿]+'), lambda t: length(t) > 1) as terms from k), st as (select count(*) as n_docs, avg(len(terms)) as avg_len from tok where len(terms) > 0),
 tf as (select id, term, len, count(*) as tf from (select id, len(terms) as len, unnest(terms) as term from tok) group by all), df as (select term, count(*) as df from tf group by term),
 qt as (select distinct qid, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9一-鿿]+'), lambda t: length(t) > 1)) as term from q),
 fts as (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) as score from qt join tf using (term) join df using (term), st group by all)),
 vec as (select qid, id, row_number() over (partition by qid order by list_cosine_similarity(cast(k.embedding as double[]), cast(q.embedding as double[])) desc, id) as rank from q, k where k.embedding is not null and q.embedding is not null),
 f as (select qid, id, sum(1.0 / (60 + rank)) as score from (select * from fts where rank <= 40 union all select * from vec where rank <= 40) group by all),
 s as (select f.qid, k.document_id, k.chunk_index, f.id, f.score / max(f.score) over (partition by f.qid) as score from f join k using (id)),
 r as (select s.*, row_number() over (partition by qid order by score desc, id) as rank from s join head using (document_id))
 select r.qid, r.document_id, r.chunk_index as hit_index, k.chunk_index, round(r.score, 6) as score from r join k on k.document_id = r.document_id and k.chunk_index between r.chunk_index - 1 and r.chunk_index + 1 where r.rank <= 5""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by words and vectors, of one namespace and of current versions only."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"))
    rows = rows.withColumn("space", F.floor(F.col("document_id") / 3) % 2).withColumn("vec_id", F.pmod(F.col("document_id") * 31 + F.col("chunk_index"), F.lit(e.count()))).join(e, "vec_id", "left").drop("vec_id")
    versions = rows.select("document_id", F.col("space").alias("namespace_id"), F.floor(F.col("document_id") / 3).alias("source_key"), F.col("document_id").alias("updated_at")).distinct()
    q = rows.where("chunk_index = 0 and document_id % 20 = 0").select(F.col("document_id").alias("qid"), F.col("content").alias("text"), "embedding")
    found = documents.search_documents(q, rows, versions=versions, scope={"space": 0})
    return found.select("qid", "document_id", "hit_index", "chunk_index", F.round("score", 6).alias("score"))


@register("select doc_id, sha256(text) as content_hash, strlen(text) as bytes from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("bytes"))


@register(f"select page_id, {FNV.format('url')} as hash, {uuid('url')} as uuid from pages")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", S.fnv1a(F.col("url")).alias("hash"), S.stable_uuid(F.col("url")).alias("uuid"))


@register(r"""with r as (select doc_id, regexp_extract_all(text, '(\p{Lu}[\p{L}\p{N}''-]*(?:[ ]\p{Lu}[\p{L}\p{N}''-]*)*)', 1) as runs from documents), u as (select doc_id, unnest(runs) as run, generate_subscripts(runs, 1) as i from r),
 b as (select doc_id, i, regexp_replace(regexp_replace(run, '^(?:(?:The|A|An|I|It|He|She|We|They|This|That|In|On|At|And|But)(?: |$))+', ''), '(?: (?:The|A|An|I|And|Of))+$', '') as entity from u),
 f as (select doc_id, entity, row_number() over (partition by doc_id order by min(i)) as n from b where length(entity) >= 2 group by doc_id, entity) select doc_id, entity from f where n <= 16""")
def title_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(documents.heuristic_entities(F.col("text"))).alias("entity"))
