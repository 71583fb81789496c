"""The engine's logical tables as views over the raw Parquet tables.

Each view is SQL text that Spark and DuckDB both run: Spark with the raw tables as DataFrames, an oracle with them as
registered views (see ``cte``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEWS: dict[str, str] = {
    "memories": """select concat('m', lpad(cast(d.doc_id as string), 7, '0')) as id, d.text as content,
  case d.doc_id % 8 when 0 then 'fact' when 1 then 'preference' when 2 then 'decision' when 3 then 'identity'
    when 4 then 'event' when 5 then 'observation' when 6 then 'goal' else 'todo' end as memory_type,
  cast((d.doc_id * 37) % 101 as double) / 100 as importance,
  case when d.doc_id % 5 < 3 then 'ns0' else 'ns1' end as namespace_id,
  concat('u', cast(d.doc_id % 7 as string)) as user_id,
  case when d.doc_id % 3 = 0 then null else concat('a', cast(d.doc_id % 4 as string)) end as agent_id,
  case when d.doc_id % 4 = 0 then '' else concat('r', cast(d.doc_id % 9 as string)) end as run_id,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * d.doc_id as created_at,
  timestamp '2024-01-01 00:00:00' + interval '1' day * ((d.doc_id * 13) % 40) as updated_at,
  timestamp '2024-01-01 00:00:00' + interval '1' day * ((d.doc_id * 29) % 60) as last_accessed_at,
  d.doc_id % 6 as access_count, d.doc_id % 11 = 0 as forgotten,
  case when d.doc_id % 4 = 1 then null else timestamp '2023-01-01 00:00:00' + interval '1' day * (d.doc_id % 365) end as event_date,
  case when d.doc_id % 9 = 4 then timestamp '2024-03-01 00:00:00' + interval '1' day * (d.doc_id % 30) else null end as valid_to,
  concat('s', cast(d.doc_id % 20 as string)) as subject,
  case d.doc_id % 5 when 0 then 'residence' when 1 then 'job' when 2 then 'pet' when 3 then 'hobby' else null end as attribute,
  case when d.doc_id % 2 = 0 then concat('ep', cast(d.doc_id % 15 as string)) else null end as episode_id,
  d.lang, d.source, e.embedding
from {documents} d left join {embeddings} e on e.vec_id = d.doc_id""",
    "edges": """select concat('m', lpad(cast(d.doc_id as string), 7, '0')) as src,
  concat('m', lpad(cast((d.doc_id * 7 + 3) % n.n as string), 7, '0')) as dst,
  case d.doc_id % 9 when 0 then 'related_to' when 1 then 'updates' when 2 then 'contradicts' when 3 then 'caused_by' when 4 then 'result_of'
    when 5 then 'part_of' when 6 then 'same_entity' when 7 then 'same_slot' else 'same_episode' end as relation,
  cast((d.doc_id * 17) % 10 + 1 as double) / 10 as weight
from {documents} d cross join (select count(*) as n from {documents}) n where (d.doc_id * 7 + 3) % n.n <> d.doc_id""",
    "mentions": """select distinct concat('m', lpad(cast(doc_id as string), 7, '0')) as memory_id, concat('e', cast(k as string)) as entity_id
from (select doc_id, doc_id % 25 as k from {documents} union all select doc_id, (doc_id * 3 + 1) % 25 as k from {documents}) x""",
    "requests": """select event_id as id, concat('w', cast(user_id % 3 as string)) as workspace_id,
  case when user_id % 5 = 0 then null else concat('k', cast(user_id % 5 as string)) end as api_token_id,
  case event_type when 'click' then 'memories.search' when 'view' then 'memories.list' when 'purchase' then 'memories.add'
    when 'signup' then 'documents.ingest' else 'memories.update' end as operation,
  case when event_type = 'error' then 'failed' else 'success' end as status,
  cast(floor(value) as bigint) as latency_ms, ts as created_at from {events}""",
    "usage": """select event_id as id, concat('w', cast(user_id % 3 as string)) as workspace_id,
  case event_id % 3 when 0 then 'model-a' when 1 then 'model-b' else 'model-unpriced' end as model,
  cast(floor(value * 10) as bigint) as input_tokens, cast(floor(value) as bigint) as output_tokens,
  cast(floor(value) as bigint) as latency_ms, event_id % 4 as retry_count,
  case when event_id % 10 = 7 then 'warning' else 'provider_usage' end as kind, ts as created_at from {events}""",
    "prices": """select * from (values
  ('p1', cast(null as string), 'model-a', 200000, 800000, timestamp '2024-01-01 00:00:00'),
  ('p2', cast(null as string), 'model-a', 150000, 600000, timestamp '2024-01-15 00:00:00'),
  ('p3', 'w1', 'model-a', 100000, 400000, timestamp '2024-01-10 00:00:00'),
  ('p4', cast(null as string), 'model-b', 2500000, 10000000, timestamp '2024-01-05 00:00:00'))
  as t(id, workspace_id, model, input_micros, output_micros, effective_at)""",
    "state_obs": """select event_id as seq, concat('u', cast(user_id % 10 as string)) as subject, event_type as attribute,
  concat('v', cast(cast(floor(value) as bigint) % 3 as string)) as value, ts as valid_from, concat('m', cast(event_id as string)) as source_id from {events}""",
    "evidence": """select concat('ev', cast(event_id as string)) as id, concat('u', cast(user_id % 10 as string)) as subject, event_type as attribute,
  concat('v', cast(cast(floor(value) as bigint) % 3 as string)) as value_key, concat('k', cast(event_id % 40 as string)) as evidence_key,
  concat('c', cast(event_id % 6 as string)) as context_id, cast(event_id % 10 + 1 as double) / 10 as weight, ts as observed_at, ts as valid_from,
  case when event_id % 7 = 0 then ts + interval '5' day else null end as valid_to from {events}""",
    "paired": """select l.doc_id as item_id, d.lang as category, l.quality as a_correct, 1 - l.toxic as b_correct from {labels} l join {documents} d on d.doc_id = l.doc_id""",
}
RAW = ("documents", "embeddings", "events", "labels", "benchmark", "conversations", "pages")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _VIEWS[name]
    used = {t: load(spark, sf_dir, t) for t in RAW if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """``with`` clause that defines the views for an engine in which the raw tables are registered."""
    return "with " + ",\n".join(f"{n} as ({_VIEWS[n].format(**{t: t for t in RAW})})" for n in names)
