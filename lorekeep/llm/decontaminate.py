"""Benchmark decontamination by winnowing.

Both sides keep the smallest 5-gram hash of every 6 consecutive 5-grams, so any shared span of 10 words
shares a kept hash. Document hashes are joined with the benchmark's in the map task, against a sorted
index that is broadcast; a hit is then extended to every 10-word window that covers it, looked up among
the benchmark's windows and compared word by word. An item of fewer than 10 words is a single window: all
document grams of its length are looked up.

A benchmark of up to ``BLOCK_BYTES`` of text is one index, and one pass marks the documents. A larger one is cut
into blocks of that size by the hash of its texts: one block after the other is indexed, broadcast, looked up in one pass
that writes the hits of the documents that have any, and dropped again. No document is shuffled but to join its hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, steps, table, unpacked
from .tokens import SLICE_BYTES, Words, gram_hash, slices, words

WINDOW = 10
GRAM = 5
#: Text of one index. Of random words it takes 430 MB of the driver to make, 28 MB to send and 82 MB of each Python worker to hold.
BLOCK_BYTES = 2 << 20


def winnowed(w: Words, hashes: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Positions whose gram is the (rightmost) smallest of some ``span`` consecutive grams of one text."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        other = hashes[j : j + n]
        take = other <= best
        best[take], at[take] = other[take], j
    inside = w.doc[:n] == w.doc[gram + span - 2 : gram + span - 2 + n]
    kept = np.zeros(len(hashes), bool)
    kept[(np.arange(n) + at)[inside]] = True
    return np.flatnonzero(kept)


@dataclass
class Index:
    grams: np.ndarray  # sorted winnowed hashes of items of at least WINDOW words
    lengths: list[int]  # the window lengths: WINDOW, and those of shorter items
    windows: dict[int, tuple[np.ndarray, list[bytes], list[list[str]]]]  # by length: sorted hashes, texts, item ids


def build_index(ids: list[str], texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Index:
    w = words(texts)
    span = window - gram + 1
    kept = winnowed(w, gram_hash(w.hash, None, gram), gram, span)
    grams = np.unique(gram_hash(w.hash, kept, gram))
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, first, count in zip(ids, w.first.tolist(), w.count.tolist(), strict=True):
        n = min(window, count)
        if n:
            for at in range(first, first + count - n + 1):
                found.setdefault(n, {}).setdefault(w.text(at, at + n), set()).add(item)
    windows = {}
    for n, by_text in found.items():
        hashes = gram_hash(words(list(by_text)).hash, np.arange(len(by_text)) * n, n)
        order = np.argsort(hashes, kind="stable")
        all_texts, all_items = list(by_text), [sorted(x) for x in by_text.values()]
        windows[n] = (hashes[order], [all_texts[i] for i in order], [all_items[i] for i in order])
    return Index(grams, sorted(found), windows)


def _among(sorted_: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return sorted_[at] == asked


def hits(index: Index, w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are inside an occurrence of a window; the items of each text that has any."""
    hit = np.zeros(len(w.hash) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for n in index.lengths:
        last = len(w.hash) - n
        if last < 0:
            continue
        if n == window:
            hashes = gram_hash(w.hash, None, gram)
            at = winnowed(w, hashes, gram, window - gram + 1)
            at = at[_among(index.grams, hashes[at])]
            at = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
        else:
            at = np.arange(last + 1)
        at = at[(at >= 0) & (at <= last)]
        at = at[w.doc[at] == w.doc[at + n - 1]]
        hashes, texts, ids = index.windows[n]
        asked = gram_hash(w.hash, at, n)
        found = _among(hashes, asked)
        at, lo, hi = at[found], np.searchsorted(hashes, asked[found]), np.searchsorted(hashes, asked[found], side="right")
        for a, b, c in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            own = w.text(a, a + n)
            for k in range(b, c):
                if texts[k] == own:
                    hit[a] += 1
                    hit[a + n] -= 1
                    items.setdefault(int(w.doc[a]), set()).update(ids[k])
    return np.cumsum(hit[:-1]) > 0, items


def text_hits(index: Index, text: bytes) -> tuple[int, np.ndarray, set[str]]:
    """Words of a long text, the numbers of those that are hit, and the items, slice by slice. Slices overlap by a word less than
    the longest window, so each window lies whole in one of them."""
    seen, hit, items = 0, [], set()
    for w, held in slices(text, lead=max(index.lengths, default=1) - 1):
        found, of = hits(index, w)
        hit.append(np.flatnonzero(found) + seen - held)
        items |= of.get(0, set())
        seen += len(w.hash) - held
    return seen, np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64), items


def batch_hits(index: Index, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """(words, numbers of the hit words, items) of each text."""
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
        yield text_hits(index, texts[0])
        return
    w = words(texts)
    hit, items = hits(index, w)
    at = np.flatnonzero(hit)
    cuts = np.searchsorted(at, w.first)
    for i, (first, count) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=True)):
        yield count, at[cuts[i] : np.searchsorted(at, first + count)] - first, items.get(i, set())


ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
FIELDS = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}


def _verdict(n_words: int, n_hit: int, items: list[str]) -> dict:
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": n_hit > 0}


def _slim(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")


def _index(rows: DataFrame) -> Index:
    got = rows.toArrow()
    return build_index(got.column("item_id").to_pylist(), got.column("text").to_pylist())


def _in_one(docs: DataFrame, index: Index, into: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.withColumn(into, F.lit(None).cast(f"struct<{', '.join(f'{k}: {t}' for k, t in FIELDS.items())}>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                made = pa.array([_verdict(n, len(at), sorted(items)) for n, at, items in batch_hits(held.value, texts)], ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def _in_blocks(docs: DataFrame, slim: DataFrame, parts: int, into: str) -> DataFrame:
    """The same for a benchmark of several blocks: documents are numbered in a written table, and the hits of all blocks are joined
    to them by that number."""
    spark = docs.sparkSession
    rows = materialize(docs.withColumn("__leak_row", F.monotonically_increasing_id()), "leak-rows")
    dealt = materialize(slim.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts))), "leak-items")
    found = None
    for k in range(parts):
        held = spark.sparkContext.broadcast(_index(dealt.where(F.col("part") == k)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in steps(batch, "text"):
                    some = [(row, at.tolist(), sorted(items)) for row, (_, at, items) in zip(part.column("__leak_row").to_pylist(), batch_hits(held.value, texts), strict=True) if len(at)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.list_(pa.int32())), pa.array([x[2] for x in some], pa.list_(pa.string()))], names=["__leak_row", "hit", "items"])

        one = materialize(rows.select("__leak_row", "text").mapInArrow(run, "__leak_row long, hit array<int>, items array<string>"), "leak-hits")
        held.destroy()
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("__leak_row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("__leak_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__leak_items"))
    joined = rows.join(merged, "__leak_row", "left")
    items = F.coalesce("__leak_items", F.array().cast("array<string>"))
    n_hit = F.coalesce("__leak_hit", F.lit(0))
    made = F.struct(n_words().alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    return joined.select(*docs.columns, made.alias(into))


def n_words(text: str = "text") -> Column:
    """Words of a text by the contract: runs of ASCII letters, digits and all that isn't ASCII (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def mark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, into: str = "__leak") -> DataFrame:
    """``docs`` (text and any others) with one more column, the struct ``into``: n_words, n_hit, n_items, items_sha256 and
    contaminated. benchmark: item_id, text.

    A null text or item has no words. A null item_id is reported as ``null``. Rows of one item_id are
    one item. Repeated document rows are marked each. An empty benchmark hits nothing; the hash is then
    that of the empty text. Long texts are read in slices. Other columns are left as they are, whatever their
    names; a column ``into`` is replaced. An empty table gives an empty table."""
    docs, slim = docs.drop(into), _slim(benchmark)
    columns, docs = docs.columns, packed(docs, "text")
    held = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-held // block_bytes))
    marked = _in_one(docs, _index(slim), "__leak") if parts == 1 else _in_blocks(docs, slim, parts, "__leak")
    return unpacked(marked, columns, ("text",), F.col("__leak").alias(into))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "__leak.*")


OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bn as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
bi as (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from bn),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from bi),
ns as (select distinct n from bw),
di as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, ns where len(w) >= n),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from di),
m as (select dw.doc_id, dw.n, dw.i, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from (select distinct doc_id, n, i from m)) group by doc_id),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items,
  coalesce(t.items_sha256, sha256('')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
