"""Registered retrieval queries. Queries of a search are the rows whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fusion, graph, lifecycle, retrieval
from ..operators.filters import visible
from ..scratch import kept
from ..sources.views import cte, load
from .registry import register
from . import sql
from .search import hybrid


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories").where(F.substring("id", 2, 7).cast("long") % 20 == 0)
    return rows.select(F.col("id").alias("qid"), F.col("content").alias("text"), "embedding", (F.col("event_date") - F.expr("interval 1 day")).alias("from"), (F.col("event_date") + F.expr("interval 1 day")).alias("to"))


def rounded(lane: DataFrame) -> DataFrame:
    return lane.select("qid", "id", F.round("score", 6).alias("score"), "rank")


# round to 9 digits before ranking would hide ties that differ by summation order; vectors here have none
_Q = "q as (select id as qid, content as text, embedding, event_date from memories where cast(substr(id, 2) as bigint) % 20 = 0)"
_VECTOR = """vec as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from (select q.qid, m.id,
  list_cosine_similarity(cast(m.embedding as double[]), cast(q.embedding as double[])) as score from q join memories m on m.id <> q.qid where m.embedding is not null and q.embedding is not null and not m.forgotten)),
vec50 as (select * from vec where rank <= 50)"""
_BM25 = """tok as (select id, list_filter(string_split_regex(lower(content), '[^a-z0-9一-鿿]+'), lambda t: length(t) > 1) as terms from memories where not forgotten),
st as (select count(*) as n_docs, avg(len(terms)) as avg_len from tok where len(terms) > 0),
tf as (select id, term, len, count(*) as tf from (select id, len(terms) as len, unnest(terms) as term from tok) group by all),
df as (select term, count(*) as df from tf group by term),
qt as (select distinct qid, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9一-鿿]+'), lambda t: length(t) > 1)) as term from q),
fts as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from (
  select qid, id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) as score from qt join tf using (term) join df using (term), st group by all)),
fts50 as (select * from fts where rank <= 50)"""
_TEMPORAL = """tmp as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from (select q.qid, m.id,
  exp(-greatest(0, epoch_ms(q.event_date - interval '1' day) - epoch_ms(m.event_date), epoch_ms(m.event_date) - epoch_ms(q.event_date + interval '1' day)) / 86400000.0 / 7.0) as score
  from q join memories m on m.event_date between q.event_date - interval '22' day and q.event_date + interval '22' day where not m.forgotten) where score > 0.01),
tmp50 as (select * from tmp where rank <= 50)"""


@register(f"{cte('memories')}, {_Q}, {_VECTOR} select qid, id, round(score, 6) as score, rank from vec50")
def lane_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.vector_lane(queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible())))


@register(f"{cte('memories')}, {_Q}, {_BM25} select qid, id, round(score, 6) as score from fts50")
def lane_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.bm25_lane(queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible()))).drop("rank")


@register(f"{cte('memories')}, {_Q}, {_TEMPORAL} select qid, id, round(score, 6) as score, rank from tmp50")
def lane_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.temporal_lane(queries_of(spark, sf_dir).where("from is not null"), load(spark, sf_dir, "memories").where(visible())))


@register(f"""{cte('memories')}, q as (select id as qid, event_date - interval '36' hour as a, event_date + interval '100' hour as b from memories where cast(substr(id, 2) as bigint) % 20 = 0 and event_date is not null),
 r as (select q.qid, m.id, row_number() over (partition by qid order by m.created_at desc, m.id desc) as rank, count(*) over (partition by qid) as n from q join memories m on m.event_date between q.a and q.b where not m.forgotten)
 select qid, id, round(1 - (rank - 1) / n::double, 6) as score, rank from r where rank <= 50""")
def lane_temporal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dated inside a range that begins and ends within days, most recent first."""
    q = load(spark, sf_dir, "memories").where(F.substring("id", 2, 7).cast("long") % 20 == 0).where("event_date is not null")
    q = q.select(F.col("id").alias("qid"), (F.col("event_date") - F.expr("interval 36 hour")).alias("from"), (F.col("event_date") + F.expr("interval 100 hour")).alias("to"))
    return rounded(retrieval.temporal_lane(q, load(spark, sf_dir, "memories").where(visible()), 0.0))


@register(f"""{cte('memories')}, tok as (select id, list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda t: length(t) > 1)) as terms from memories where not forgotten),
 st as (select count(*)::double as n, avg(len(coalesce(terms, []))) as avg_len from tok), p as (select id, len(terms) as len, unnest(terms) as term from tok), df as (select term, count(*) as df from p group by term),
 qt as (select conv_id as qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 1))) as term from conversations where turn = 0),
 s as (select qid, p.id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * max(len) / max(avg_len))), 9) as score from qt join p using (term) join df using (term), st group by all),
 r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, rank from r where rank <= 20""")
def lane_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written index, searched with the first turn of every conversation."""
    from ..operators.lexical import Index

    q = load(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("qid"), "text")
    return Index.of(load(spark, sf_dir, "memories").where(visible())).search(q, 20).select("qid", "id", "rank")


_FUSED = f"""{cte('memories')}, {_Q}, {_VECTOR}, {_BM25}, {_TEMPORAL},
parts as (select qid, id, 1.0 / (60 + rank) as part from vec50 union all select qid, id, 0.4 / (60 + rank) from fts50 union all select qid, id, 0.8 / (60 + rank) from tmp50),
fused as (select qid, id, sum(part) as score from parts group by all)"""


@register(f"{_FUSED} select qid, id, round(score, 6) as score from fused")
def fused_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, m = queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible())
    lanes = {"vector": retrieval.vector_lane(q, m), "fts": retrieval.bm25_lane(q, m), "temporal": retrieval.temporal_lane(q.where("from is not null"), m)}
    return rounded(fusion.rrf(lanes, {"vector": 1.0, "fts": 0.4, "temporal": 0.8})).drop("rank")


@register(f"{cte('memories')}, {_Q}, {_VECTOR}, {_TEMPORAL}, p as (select qid, id, least(greatest(score * 0.9, 0), 0.999) as x from vec50 union all select qid, id, least(greatest(score * 0.5, 0), 0.999) from tmp50) select qid, id, round(1 - exp(sum(ln(1 - x))), 6) as score from p group by all")
def fused_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, m = queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible())
    lanes = {"vector": retrieval.vector_lane(q, m), "temporal": retrieval.temporal_lane(q.where("from is not null"), m), "fts": retrieval.vector_lane(q, m)}
    lanes = {n: lane.withColumnRenamed("score", "p") for n, lane in lanes.items()}
    return fusion.noisy_or(lanes, {"vector": 0.9, "temporal": 0.5}).withColumn("score", F.round("score", 6))


_FACTOR = "case relation when 'updates' then 1.5 when 'caused_by' then 1.3 when 'result_of' then 1.3 when 'related_to' then 1.0 when 'part_of' then 0.8 when 'contradicts' then 0.5 when 'same_slot' then 1.25 when 'same_entity' then 0.85 else 0.65 end"
_UND = f"""one as (select least(src, dst) as x, greatest(src, dst) as y, relation, max(weight * {_FACTOR}) as w from edges where src <> dst group by all),
und as (select a, b, sum(w) as w from (select x as a, y as b, w from one union all select y, x, w from one) group by all),
sh as (select a, b, w / sum(w) over (partition by a) as share from und),
seed as (select id as qid, id, 1.0::double as r from memories where cast(substr(id, 2) as bigint) % 20 = 0)"""


_ENTITY = f"""ee as (select memory_id as a, entity_id as b, 1.0::double as w from mentions union all select entity_id, memory_id, 1.0 from mentions
 union all select src, dst, weight * {_FACTOR} * case relation when 'updates' then 0.4 when 'caused_by' then 0.6 when 'result_of' then 0.6 else 1.0 end from edges union all select dst, src, weight * {_FACTOR} from edges),
und as (select a, b, sum(w) as w from ee where a <> b group by all), sh as (select a, b, w / sum(w) over (partition by a) as share from und), seed as (select id as qid, id, 1.0::double as r from memories where cast(substr(id, 2) as bigint) % 20 = 0)"""


def _pagerank_sql(rounds: int, entities: bool = False) -> str:
    steps = ["p0 as materialized (select qid, id, r as p from seed)"]
    for k in range(rounds):
        steps.append(f"l{k} as materialized (select p.qid, sh.b as id, 0.5 * sum(p.p * coalesce(sh.share, 1.0)) as p from p{k} p left join sh on sh.a = p.id group by all)")
        steps.append(f"p{k + 1} as materialized (select qid, id, sum(p) as p from (select qid, id, p from l{k} where id is not null union all select s.qid, s.id, (0.5 + coalesce(d.p, 0)) * s.r from seed s left join (select qid, p from l{k} where id is null) d on d.qid = s.qid) group by all)")
    if entities:
        return f"{cte('memories', 'edges', 'mentions')}, {_ENTITY}, {', '.join(steps)} select qid, id, round(p, 6) as score from p{rounds} where id not in (select entity_id from mentions)"
    return f"{cte('memories', 'edges')}, {_UND}, {', '.join(steps)} select qid, id, round(p, 6) as score from p{rounds} where round(p, 6) > 0"


@register(_pagerank_sql(15))
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = queries_of(spark, sf_dir).select("qid", F.col("qid").alias("id"), F.lit(1.0).alias("mass"))
    return graph.pagerank(seeds, graph.undirected(load(spark, sf_dir, "edges"))).withColumn("score", F.round("score", 6)).where("score > 0")


@register(f"{cte('memories', 'edges')}, b as (select src as a, dst as b from edges union select dst, src from edges), s as (select id as seed from memories where cast(substr(id, 2) as bigint) % 20 = 0), h1 as (select distinct seed, b.b as id from s join b on b.a = s.seed where b.b <> s.seed), h2 as (select distinct h1.seed, b.b as id from h1 join b on b.a = h1.id where b.b <> h1.seed) select seed, id, 1 as hop from h1 union all select seed, id, 2 from (select * from h2 except select * from h1)")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(queries_of(spark, sf_dir).select(F.col("qid").alias("id")), load(spark, sf_dir, "edges"), 2)


def _push_sql(depth: int) -> str:
    steps = []
    for k in range(depth + 1):
        steps.append(f"s{k} as materialized (select f.qid, b.b as id, b.relation, b.score from f{k} f join both_ b on b.a = f.id where not exists (select 1 from n{k} n where n.qid = f.qid and n.id = b.b))")
        steps.append(f"f{k + 1} as materialized (select distinct qid, id from s{k} where relation in ('related_to', 'part_of'))")
        steps.append(f"n{k + 1} as materialized (select qid, id from n{k} union select qid, id from s{k})")
    parts = " union all ".join(["select qid, id, 1.0::double as score from f0", *(f"select qid, id, score from s{k}" for k in range(depth + 1))])
    return f"""{cte('memories', 'edges')}, both_ as (select e.a, e.b, e.relation, m.importance * e.f as score from (select src as a, dst as b, relation, weight * {_FACTOR} as f from edges union all select dst, src, relation, weight * {_FACTOR} from edges) e join memories m on m.id = e.b),
 f0 as (select id as qid, id from memories where cast(substr(id, 2) as bigint) % 20 = 0), n0 as (select * from f0), {', '.join(steps)} select qid, id, round(max(score), 6) as score from ({parts}) group by all"""


@register(_push_sql(2))
def graph_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = queries_of(spark, sf_dir).select("qid", F.col("qid").alias("id"), F.lit(1.0).alias("mass"))
    return graph.push_scores(seeds, load(spark, sf_dir, "memories"), load(spark, sf_dir, "edges")).withColumn("score", F.round("score", 6))


@register(f"{cte('memories', 'edges')}, {_Q}, {_VECTOR}, r as (select qid, id, score from vec where rank <= 10), u as (select r.qid, e.src as id, r.score * 0.999 as score from r join edges e on e.dst = r.id and e.relation = 'updates') select qid, id, round(max(score), 6) as score from (select * from r union all select * from u) group by all")
def follow_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.vector_lane(queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible()), 10)
    return graph.successors(hits, load(spark, sf_dir, "edges")).withColumn("score", F.round("score", 6))


@register(f"{cte('mentions')} select memory_id, count(distinct entity_id) as entities, round(max(least(0.12, 0.3 / sqrt(n))), 6) as boost from mentions join (select entity_id, count(*) as n from mentions group by 1) using (entity_id) group by memory_id")
def entity_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "mentions")
    n = m.groupBy("entity_id").agg(F.count("*").alias("n"))
    boost = F.least(F.lit(0.12), 0.3 / F.sqrt(F.greatest("n", F.lit(1))))
    return m.join(n, "entity_id").groupBy("memory_id").agg(F.count_distinct("entity_id").alias("entities"), F.round(F.max(boost), 6).alias("boost"))


_SAID = "' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> ''), ' ') || ' '"
_WHEN = " ".join(f"when {' or '.join([f"starts_with(q, ' {w} ')" for w in first] + [f"contains(q, ' {w} ')" for w in anywhere])} then '{name}'" for name, first, anywhere in retrieval.INTENTS)


@register(f"with t as (select conv_id, turn, {_SAID} as q from conversations) select conv_id, turn, case {_WHEN} else 'multi_hop' end as intent from t")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.intent(F.col("text")).alias("intent"))


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@register(f"select item_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 and t not in ({_STOP})))) as terms from benchmark")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_sort(S.content_terms(F.col("text"))).alias("terms"))


# the fit of point i is the largest over starts j <= i of the smallest mean of j to k over ends k >= i; equal values are one block
_FIT = """pool as (select source, score, sum(label)::double as s, count(*)::double as n from points group by all),
 pre as (select source, score, row_number() over w as i, sum(s) over w as su, sum(n) over w as nu, s, n from pool window w as (partition by source order by score)),
 span as (select a.source, a.i as j, b.i as k, (b.su - a.su + a.s) / (b.nu - a.nu + a.n) as mean from pre a join pre b on b.source is not distinct from a.source and b.i >= a.i),
 low as (select source, j, k as i, min(mean) over (partition by source, j order by k desc) as least from span),
 fit as (select source, i, max(least) as y from low group by all),
 curve as (select pre.source, min(score) as x, y from fit join pre on pre.i = fit.i and pre.source is not distinct from fit.source group by pre.source, y)"""


@register(f"""with q as (select vec_id as qid, embedding, label as q_label from embeddings where vec_id % 20 = 0),
 v as (select q.qid, q.q_label, e.vec_id as id, e.label, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as score from q join embeddings e on e.vec_id <> q.qid),
 r as (select *, row_number() over (partition by qid order by score desc, id) as rank from v), points as (select q_label as source, round(score, 9) as score, (label = q_label)::int as label from r where rank <= 50),
 {_FIT} select source, round(x, 6) as x, round(y, 6) as y from curve""")
def calibration_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic fits of label agreement on cosine, for every label of the query."""
    e = load(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("q_label"))
    hits = retrieval.vector_lane(q, e.select(F.col("vec_id").alias("id"), "embedding"))
    rows = hits.join(q.select("qid", "q_label"), "qid").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    fit = fusion.isotonic(rows.select(F.col("q_label").alias("source"), F.round("score", 9).alias("score"), (F.col("label") == F.col("q_label")).cast("int").alias("label")))
    return fit.select("source", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


CALIBRATED = {"vector": 0.9, "fts": 0.6, "temporal": 0.5}


@register(f"""{cte('memories')}, {_Q}, {_VECTOR}, {_BM25}, {_TEMPORAL},
 lanes as (select 'vector' as source, 0.9 as w, qid, id, score from vec50 union all select 'fts', 0.6, qid, id, score from fts50 union all select 'temporal', 0.5, qid, id, score from tmp50),
 points as (select lanes.source, round(lanes.score, 6) as score, (m.source is not distinct from t.source)::int as label from lanes join memories m on m.id = lanes.id join memories t on t.id = lanes.qid where cast(substr(lanes.qid, 2) as bigint) % 40 = 0),
 {_FIT}, seg as (select source, x, y, lead(x) over w as x2, lead(y) over w as y2, row_number() over w as nr from curve window w as (partition by source order by x)),
 here as (select l.*, s.x, s.y, s.x2, s.y2, f.y as y1 from (select source, w, qid, id, round(score, 6) as score from lanes) l join seg f on f.source = l.source and f.nr = 1 left join seg s on s.source = l.source and s.x <= l.score and (s.x2 is null or s.x2 > l.score)),
 p as (select qid, id, w * case when x is null then y1 when x2 is null then y else y + (y2 - y) * (score - x) / (x2 - x) end as p from here),
 f as (select qid, id, round(1 - exp(sum(ln(1 - least(greatest(p, 0.0), 0.999)))), 9) as score from p group by all)
 select qid, id, score from f""")
def fused_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes fused on curves that are fitted on the hits of half of the queries; a hit is right if it has the query's source."""
    q, m = queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible())
    lanes = {"vector": retrieval.vector_lane(q, m), "fts": retrieval.bm25_lane(q, m), "temporal": retrieval.temporal_lane(q.where("from is not null"), m)}
    lanes = {n: kept(lane.withColumn("score", F.round("score", 6)), f"lane-{n}") for n, lane in lanes.items()}
    fit = lane_curves(lanes, load(spark, sf_dir, "memories"), F.substring("qid", 2, 7).cast("long") % 40 == 0)
    return fusion.calibrated(lanes, fit, CALIBRATED).select("qid", "id", "score")


def lane_curves(lanes: dict[str, DataFrame], memories: DataFrame, learnt: Column) -> DataFrame:
    """The curve of each lane, from the hits of the queries for which ``learnt`` holds; a hit is right if it has the source of the query's row."""
    told = memories.select("id", F.col("source").alias("of"))
    hits = fusion.traced(lanes).where(learnt).join(told, "id").join(told.select(F.col("id").alias("qid"), F.col("of").alias("asked")), "qid")
    return fusion.curves_of(fusion.isotonic(hits.select(F.col("lane").alias("source"), "score", F.col("of").eqNullSafe(F.col("asked")).cast("int").alias("label"))))


@register()
def search_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with calibrated fusion, on curves of the vector and temporal lanes."""
    q, m = queries_of(spark, sf_dir), load(spark, sf_dir, "memories")
    seen = m.where(visible())
    lanes = {"vector": retrieval.vector_lane(q, seen), "temporal": retrieval.temporal_lane(q.where("from is not null"), seen)}
    return hybrid(q, m, weights=CALIBRATED, curves=lane_curves(lanes, m, F.substring("qid", 2, 7).cast("long") % 40 == 0))


@register()
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lanes, fusion and the greedy cut for all queries at once."""
    return hybrid(queries_of(spark, sf_dir), load(spark, sf_dir, "memories"), load(spark, sf_dir, "edges"))


@register(f"{cte('memories')}, r as (select *, row_number() over (partition by namespace_id order by created_at desc, id desc) as rank, count(*) over (partition by namespace_id) as n from memories where not forgotten) select namespace_id, id, round(case when n <= 1 then 1.0 else 1 - (rank - 1) / n::double end, 6) as score, rank from r where rank <= 50")
def search_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import metadata_search

    rows = metadata_search(load(spark, sf_dir, "memories"), "recent", 50, "namespace_id")
    return rows.select("namespace_id", "id", F.round("score", 6).alias("score"), "rank")


@register(f"""{cte('memories', 'edges', 'mentions')}, ee as (select memory_id as a, entity_id as b, 1.0::double as w from mentions union all select entity_id, memory_id, 1.0 from mentions
 union all select src, dst, weight * {_FACTOR} * case relation when 'updates' then 0.4 when 'caused_by' then 0.6 when 'result_of' then 0.6 else 1.0 end from edges union all select dst, src, weight * {_FACTOR} from edges) select a, b, round(sum(w), 6) as w from ee where a <> b group by all""")
def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_edges(load(spark, sf_dir, "edges"), load(spark, sf_dir, "mentions")).withColumn("w", F.round("w", 6))


@register(_pagerank_sql(15, True))
def graph_entity_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = queries_of(spark, sf_dir).select("qid", F.col("qid").alias("id"), F.lit(1.0).alias("mass"))
    return graph.entity_pagerank(seeds, load(spark, sf_dir, "edges"), load(spark, sf_dir, "mentions"), digits=6)  # rounded where they are made, not pair by pair


# entities are named by their ids; a query is a row's text and the name of an entity
_NAMED = "q as (select id as qid, content || ' and e' || cast(cast(substr(id, 2) as bigint) % 25 as varchar) as text, embedding from memories where cast(substr(id, 2) as bigint) % 20 = 0)"
_NAMES = "named as (select q.qid, e.entity_id from q join (select distinct entity_id from mentions) e on list_contains(string_split_regex(lower(q.text), '[^\\p{L}\\p{N}]+'), e.entity_id))"


def named_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("qid", 2, 7).cast("long") % 25
    return queries_of(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" and e"), n.cast("string")))


def entities_of(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("name")).distinct()


def _walk_sql(rounds: int, epsilon: float, hops: int) -> str:
    steps = []
    for k in range(rounds):
        steps.append(f"g{k} as materialized (select *, round(r, 12) >= {epsilon} * edges and hop < {hops} as ready from s{k})")
        steps.append(f"""s{k + 1} as materialized (select qid, id, max(edges) as edges, min(hop) as hop, sum(p) as p, sum(r) as r from (
 select qid, id, edges, hop, p + case when ready then 0.5 * r else 0 end as p, case when ready then 0 else r end as r from g{k}
 union all select g.qid, sh.b, d.edges, g.hop + 1, 0, 0.5 * g.r * sh.share from g{k} g join sh on sh.a = g.id join deg d on d.a = sh.b where g.ready) group by all)""")
    return f"""{cte('memories', 'edges', 'mentions')}, {_NAMED}, {_NAMES}, {_ENTITY.replace('seed as (', 'unused as (')}, deg as (select a, count(*) as edges from und group by a),
 seed as (select qid, id, sum(mass) as mass from (select qid, qid as id, 1.0::double as mass from q union all select qid, entity_id, 1.0 from named) group by all),
 st as (select seed.*, deg.edges, mass / (sum(mass) over (partition by qid) - 0.5 * sum(case when deg.edges is null then mass else 0 end) over (partition by qid)) as r from seed left join deg on deg.a = seed.id),
 s0 as materialized (select qid, id, edges, 0 as hop, case when edges is null then 0.5 * r else 0 end as p, case when edges is null then 0 else r end as r from st), {', '.join(steps)},
 f as (select *, round(p + 0.5 * r, 9) as score, round(0.5 * sum(r) over (partition by qid), 9) as slack from s{rounds}),
 k as (select *, row_number() over (partition by qid order by score desc, id) as rank from f where id in (select id from memories))
 select qid, id, round(score, 6) as score, round(slack, 6) as slack from k where rank <= 50 and score > 0"""


@register(_walk_sql(8, 1e-3, 3))
def graph_entity_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk from a row and the entities that its query names, to the 50 best rows."""
    q, mentions = named_queries(spark, sf_dir), load(spark, sf_dir, "mentions")
    seeds = q.select("qid", F.col("qid").alias("id"), F.lit(1.0).alias("mass"))
    found = graph.entity_walk(seeds, lifecycle.named_entities(q, entities_of(mentions)), load(spark, sf_dir, "memories"), load(spark, sf_dir, "edges"), mentions)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.round("slack", 6).alias("slack"))


_SLOT = f"""least(1.0, case when length(m.subject) > 0 and contains(lower(q.text), lower(m.subject)) then 0.3 else 0.0 end
 + case when coalesce(len(list_filter(string_split_regex(lower(m.attribute), '[^\\p{{L}}\\p{{N}}]+'), lambda p: length(p) >= 3 and contains(lower(q.text), p))) > 0, false) then 0.25 else 0.0 end
 + 0.45 * (len(list_intersect({sql.content_terms('q.text')}, {sql.content_terms('m.content')}))::double / greatest(len({sql.content_terms('q.text')}), 1)))"""


@register(f"""{cte('memories')}, {_Q}, {_VECTOR}, {_BM25}, p as (select coalesce(v.qid, t.qid) as qid, coalesce(v.id, t.id) as id, v.score as cosine, t.score as bm25, v.rank as v_rank, t.rank as t_rank from (select * from vec where rank <= 60) v full join (select * from fts where rank <= 60) t on v.qid = t.qid and v.id = t.id),
 b as (select *, greatest(1.0, max(bm25) over (partition by qid)) as most from p),
 s as (select b.qid, b.id, round(0.62 * coalesce(least(greatest(b.cosine, 0.0), 1.0), 0.0) + 0.26 * coalesce(b.bm25 / b.most, 0.0) + 0.08 * {_SLOT} + 0.04 * (coalesce(1.0 / (60 + b.v_rank), 0.0) + coalesce(1.0 / (60 + b.t_rank), 0.0)), 9) as score from b join memories m on m.id = b.id join q on q.qid = b.qid),
 r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, round(score, 6) as score from r where rank <= 5""")
def search_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import precision

    return rounded(precision(queries_of(spark, sf_dir), load(spark, sf_dir, "memories"))).drop("rank")


@register(f"""{cte('memories', 'mentions')}, {_NAMED}, {_NAMES}, {_VECTOR}, {_BM25}, sz as (select entity_id, count(*) as n from mentions group by 1),
 eb as (select qid, m.memory_id as id, max(least(0.12, 0.3 / sqrt(sz.n))) as boost from named join sz using (entity_id) join mentions m using (entity_id) group by all),
 p as (select coalesce(v.qid, t.qid) as qid, coalesce(v.id, t.id) as id, v.score as cosine, t.score as bm25, v.rank as v_rank, t.rank as t_rank from (select * from vec where rank <= 60) v full join (select * from fts where rank <= 60) t on v.qid = t.qid and v.id = t.id),
 b as (select p.*, eb.boost, greatest(1.0, max(bm25) over (partition by qid)) as most from p left join eb using (qid, id)),
 s as (select b.qid, b.id, round(0.62 * coalesce(least(greatest(b.cosine, 0.0), 1.0), 0.0) + 0.26 * coalesce(b.bm25 / b.most, 0.0) + 0.08 * least(1.0, {_SLOT} + coalesce(b.boost, 0.0)) + 0.04 * (coalesce(1.0 / (60 + b.v_rank), 0.0) + coalesce(1.0 / (60 + b.t_rank), 0.0)), 9) as score from b join memories m on m.id = b.id join q on q.qid = b.qid),
 r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, round(score, 6) as score from r where rank <= 5""")
def search_precision_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-fact search with the boosts of the entities that a query names."""
    from .search import precision

    q, mentions = named_queries(spark, sf_dir), load(spark, sf_dir, "mentions")
    return rounded(precision(q, load(spark, sf_dir, "memories"), entities=entities_of(mentions), mentions=mentions)).drop("rank")


_HOPS = "".join(f", f{k} as (select * from f{k - 1} union select f.qid, f.subject, f.attribute, w.new from f{k - 1} f join w using (id))" for k in range(1, 6))


@register(f"""{cte('memories', 'edges')}, {_Q}, {_VECTOR}, s as (select id, lower(subject) as subject, lower(attribute) as attribute, coalesce(event_date, created_at) as at, valid_to from memories where subject is not null and attribute is not null),
 w as (select e.dst as id, e.src as new from edges e join s a on a.id = e.dst join s b on b.id = e.src and b.subject = a.subject and b.attribute = a.attribute where relation = 'updates'),
 f0 as (select qid, subject, attribute, id from vec join s using (id) where rank <= 10){_HOPS}
 select f.qid, f.subject, f.attribute, list(s.id order by s.at, s.id) as ids from f5 f join s using (id) group by all having count(*) >= 2 or bool_or(s.valid_to is not null)""")
def belief_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.vector_lane(queries_of(spark, sf_dir), load(spark, sf_dir, "memories").where(visible()), 10)
    return graph.chains(hits, load(spark, sf_dir, "memories"), load(spark, sf_dir, "edges"))


@register(f"""{cte('memories')}, f as (select * from memories where embedding is not null order by id limit 256), u as (select generate_subscripts(embedding, 1) as i, unnest(embedding) as x from f), m as (select i, avg(x::double) as x from u group by i),
 r as (select id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from memories where embedding is not null), c as (select r.id, sum(case when r.id > (select max(id) from f) then r.x - m.x else r.x end) as total from r join m using (i) group by r.id) select id, round(total, 4) as total from c""")
def centred_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import centred

    rows = centred(load(spark, sf_dir, "memories").where("embedding is not null").select("id", "embedding"), "id")
    return rows.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import hashed_embedding

    return hashed_embedding(load(spark, sf_dir, "documents"), "doc_id", "text", 64)
