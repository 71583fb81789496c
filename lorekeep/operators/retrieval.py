"""Candidate lanes for a DataFrame of queries at once: vectors, BM25, time and graph seeds.

A lane is (qid, id, score). Queries are a stated, small set; memories are scanned once for all of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_terms
from ..scratch import kept

K1, B = 1.5, 0.75
#: Queries that are broadcast at most; a larger set is cut into blocks of so many.
QUERY_BLOCK = 10_000
#: Terms or numbers of a block of queries.
BLOCK_VALUES = 1 << 21
#: Pairs of a row and a query that a task holds at once, in about ten arrays; so many rows are found besides the best ones until they are cut.
STEP_VALUES = 1 << 17
#: Batches of found rows until they are made one, as a batch of few rows takes more memory than they do.
HELD_BATCHES = 256
#: Scores are compared with this much room before they are rounded.
ROOM = 1e-8
#: Pairs of rows and a block of queries from which a part of the rows is scored first, for what a result must score at least; that part.
FIRST_PAIRS, FIRST_PART = 1 << 29, 8


def top(lane: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return lane.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _parts(queries: DataFrame, size: Column) -> list[DataFrame]:
    """The queries in blocks by the hash of their ids, each of about QUERY_BLOCK rows and BLOCK_VALUES values at most."""
    rows, values = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-rows // QUERY_BLOCK), -(-values // BLOCK_VALUES))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)]


def _best(scores: np.ndarray, ids: pa.Array, qids: pa.Array, limit: int, own: np.ndarray | None = None, least: np.ndarray | None = None, digits: int | None = None, above: float = -np.inf, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pa.RecordBatch:
    """The ``limit`` best rows of each query (a column of ``scores``), by score and then id. own: pairs to be left out; least: what a row of each query must
    score to be a result, as far as is known; digits: scores are rounded to; above: what no result scores; exact: the scores of pairs (row, query) for which those given may be off in their last
    digits, so that equal rows tie; rows that share a query's last place are then all given."""
    if own is not None:
        scores = np.where(own, -np.inf, scores)
    if least is not None:
        row, query = np.divmod(np.flatnonzero(scores >= np.maximum(least - ROOM, np.nextafter(above, np.inf))), scores.shape[1])
        if len(row) <= limit * scores.shape[1]:
            found = scores[row, query] if exact is None else exact(row, query)
            found = found if digits is None else np.round(found, digits)
            some = np.flatnonzero((found > above) & (found >= least[query]))
            return pa.RecordBatch.from_arrays([qids.take(pa.array(query[some])), ids.take(pa.array(row[some])), pa.array(found[some])], names=["qid", "id", "score"])
    if exact is not None:
        bound = np.full(scores.shape[1], -np.inf) if len(scores) <= limit else np.partition(scores, len(scores) - limit, axis=0)[len(scores) - limit]
        bound = bound if least is None else np.maximum(bound, least)
        row, query = np.nonzero(np.isfinite(scores) & (scores >= bound - ROOM))
        found = exact(row, query)
        found = found if digits is None else np.round(found, digits)
        some = np.flatnonzero((found > above) if least is None else (found > above) & (found >= least[query]))
        return pa.RecordBatch.from_arrays([qids.take(pa.array(query[some])), ids.take(pa.array(row[some])), pa.array(found[some])], names=["qid", "id", "score"])
    scores = scores if digits is None else np.round(scores, digits)
    keep = np.isfinite(scores) & (scores > above)
    if least is not None:
        keep &= scores >= least
    if len(scores) > limit:
        order = pc.array_sort_indices(ids)  # rows by id: of equal scores the first ones stay
        ids, scores, keep = ids.take(order), scores[order.to_numpy()], keep[order.to_numpy()]
        last = np.partition(scores, len(scores) - limit, axis=0)[len(scores) - limit]
        higher, equal = scores > last, scores == last
        keep &= higher | (equal & (np.cumsum(equal, axis=0) <= limit - higher.sum(axis=0)))
    row, query = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([qids.take(pa.array(query)), ids.take(pa.array(row)), pa.array(scores[row, query])], names=["qid", "id", "score"])


def _trimmed(found: Iterator[pa.RecordBatch], limit: int, queries: int, least: tuple[pa.Array, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The best rows of each query over all of a task's steps: with many queries a step has few rows, which its own cut would all let through. least: the queries and
    what their rows must score, which grows with each cut, so that later steps let little through."""
    held, n = [], 0
    for batch in found:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n > 2 * limit * queries + STEP_VALUES:
            held = _cut(held, limit, least).to_batches()
            n = sum(b.num_rows for b in held)
        elif len(held) > HELD_BATCHES:
            held = pa.Table.from_batches(held).combine_chunks().to_batches()
    if n:
        yield from _cut(held, limit).to_batches(max_chunksize=1 << 16)


def _cut(held: list[pa.RecordBatch], limit: int, least: tuple[pa.Array, np.ndarray] | None = None) -> pa.Table:
    """The ``limit`` best rows of each query, by score and then id. Ids are compared only where a query's last place is shared. Empties ``held``, so that its rows
    are not there twice."""
    rows = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    coded = rows.column("qid").combine_chunks().dictionary_encode()
    query, score = coded.indices.to_numpy(), rows.column("score").to_numpy()
    order = np.lexsort((-score, query))
    query, score = query[order], score[order]
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    sizes = np.diff(np.append(starts, len(query)))
    last = np.repeat(score[starts + np.minimum(sizes, limit) - 1], sizes)
    keep = score > last
    tied = np.flatnonzero(score == last)
    if len(tied):
        room = limit - np.add.reduceat(keep.astype(np.int64), starts)
        by_id = pc.sort_indices(pa.table({"query": query[tied], "id": rows.column("id").take(pa.array(order[tied]))}), sort_keys=[("query", "ascending"), ("id", "ascending")]).to_numpy()
        tied = tied[by_id]
        of = np.searchsorted(query[starts], query[tied])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(tied)) - np.repeat(first, np.diff(np.append(first, len(tied))))
        keep[tied[place < room[of]]] = True
    if least is not None:
        full = np.flatnonzero(sizes >= limit)
        at = pc.index_in(coded.dictionary.take(pa.array(query[starts[full]])), least[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        least[1][at] = np.maximum(least[1][at], score[starts[full] + limit - 1])
    return rows.take(pa.array(order[keep]))


def _matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``width`` (longer ones are cut: the dimensions of both sides count), and their lengths."""
    at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(at)
    row, column = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat[at[0] : at[-1]])) - np.repeat(at[:-1] - at[0], sizes)
    out, values = np.zeros((len(sizes), width)), flat[at[0] : at[-1]]
    inside = column < width
    out[row[inside], column[inside]] = values[inside]
    return out, np.sqrt(np.bincount(row, values * values, len(sizes)))


def _cosines(x: np.ndarray, x_norm: np.ndarray, q: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
    size = x_norm[:, None] * q_norm[None, :]
    return np.divide(x @ q.T, size, out=np.zeros_like(size), where=size > 0)


def _pair_cosines(x: np.ndarray, x_norm: np.ndarray, q: np.ndarray, q_norm: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The cosines of some pairs, each summed in one order: in a product of matrices it depends on a row's place, so that equal rows may differ."""
    total, step = np.empty(len(row)), max(1, STEP_VALUES // max(1, x.shape[1]))
    for at in range(0, len(row), step):
        some = slice(at, at + step)
        total[some] = (x[row[some]] * q[query[some]]).sum(axis=1)
    size = x_norm[row] * q_norm[query]
    return np.divide(total, size, out=np.zeros_like(size), where=size > 0)


def vector_lane(queries: DataFrame, memories: DataFrame, limit: int = 50, exclude_self: bool = True) -> DataFrame:
    """Exact cosine of every query with every row that has a vector, best first. queries: qid, embedding.

    Queries are broadcast a block at a time. A task multiplies batches of rows with the block and sends on only the best of each batch
    and query, so what is shuffled is a small part of the pairs."""
    m = memories.where("embedding is not null").select("id", "embedding")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {m.schema['id'].dataType.simpleString()}, score double"
    found = []
    for part in _parts(queries.where("embedding is not null").select("qid", "embedding"), F.size("embedding")):
        block = part.toArrow().combine_chunks()
        if not block.num_rows:
            continue
        held = memories.sparkSession.sparkContext.broadcast(block)

        def scored(batches: Iterator[pa.RecordBatch], least: np.ndarray, held=held) -> Iterator[pa.RecordBatch]:
            qids, vectors = held.value.column("qid").chunk(0), held.value.column("embedding").chunk(0)
            q, q_norm = _matrix(vectors, int(np.diff(vectors.offsets.to_numpy()).max()))
            step = max(limit, STEP_VALUES // max(1, len(q)))
            names = qids.cast(pa.string())
            for batch in batches:
                # a query is left out of its own results
                own = pc.fill_null(pc.index_in(batch.column("id").cast(pa.string()), names), -1).to_numpy() if exclude_self else None
                for at in range(0, batch.num_rows, step):
                    ids, rows = batch.column("id").slice(at, step), batch.column("embedding").slice(at, step)
                    x, x_norm = _matrix(rows, q.shape[1])
                    cosine_ = _cosines(x, x_norm, q, q_norm)
                    if own is not None:
                        row = np.flatnonzero(own[at : at + step] >= 0)
                        cosine_[row, own[at + row]] = -np.inf
                    yield _best(cosine_, ids, qids, limit, least=least, exact=partial(_pair_cosines, x, x_norm, q, q_norm))

        def run(batches: Iterator[pa.RecordBatch], scored=scored, held=held) -> Iterator[pa.RecordBatch]:
            qids = held.value.column("qid").chunk(0)
            least = np.full(len(qids), -np.inf)
            return _trimmed(scored(batches, least), limit, len(qids), (qids, least))

        found.append(m.mapInArrow(run, schema))
    return top(reduce(DataFrame.unionByName, found) if found else memories.sparkSession.createDataFrame([], schema), limit)


#: Bytes of text and terms that a task takes apart at once, of the rows that it is given together.
TEXT_BYTES, TERM_VALUES = 1 << 20, 1 << 19


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows, each of ``most`` in all but for what its last row has more."""
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(lo, hi - lo)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    return slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64), TEXT_BYTES)


#: A term: two letters of a to z, digits or Han characters at least, in lower case.
TERM = re.compile("[a-z0-9一-鿿]{2,}")


def _with_terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, counts, length) of the rows that have terms: their distinct terms, how often they have each, and how many they have in all; the same terms as
    ``index_terms`` at a tenth of its cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "low")):
            found = [Counter(TERM.findall(t)) if t else Counter() for t in batch.column("low").to_pylist()]
            some = np.flatnonzero([len(f) > 0 for f in found])
            columns = [pa.array([list(found[i]) for i in some], pa.list_(pa.string())), pa.array([list(found[i].values()) for i in some], pa.list_(pa.int32())), pa.array([found[i].total() for i in some], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some)), *columns], names=[key, "terms", "counts", "length"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.lower(text).alias("low")).mapInArrow(run, f"{key} {kind}, terms array<string>, counts array<int>, length long")


#: Rows from which copies are looked for; the share of the rows that are copies from which each text is taken once; first rows of texts that are broadcast at most.
MANY_ROWS, COPIES_SHARE, SENT_ROWS = 20_000, 1 / 4, 1 << 20


def once(rows: DataFrame, key: str, text: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The first row by key of each text, and how many rows have it: (key, text, copies); and (of, key): each row with the one that stands for it, of each text its
    ``most`` first rows (None: all). All rows and None where few are copies or keys are not unique. Texts are equal if their SHA-256 is."""
    every = rows.select(key, text, F.lit(1).cast("long").alias("copies")), None
    told = rows.where(F.col(text).isNotNull())
    if told.select(key).count() < MANY_ROWS:
        return every
    marks = kept(told.select(key, F.unhex(F.sha2(text, 256)).alias("mark")), "text-marks")
    n, keys, different = marks.agg(F.count("*"), F.count_distinct(key), F.count_distinct("mark")).first()
    if not n or keys < n or different > (1 - COPIES_SHARE) * n:
        return every
    first = kept(marks.groupBy("mark").agg(F.min(key).alias("of"), F.count("*").alias("copies")), "first-rows")
    meant = first.select(F.col("of").alias(key), "copies")
    texts = rows.select(key, text).join(F.broadcast(meant) if different <= SENT_ROWS else meant.hint("shuffle_hash"), key)
    held = marks if most is None else marks.withColumn("place", F.row_number().over(Window.partitionBy("mark").orderBy(key))).where(F.col("place") <= most)
    return texts.select(key, text, "copies"), kept(held.join(first, "mark").select("of", key), "rows-of-texts")


def for_each(found: DataFrame, rows: DataFrame | None, queries: DataFrame | None, limit: int) -> DataFrame:
    """A lane of the first rows and queries of each text as one of all rows and queries. rows (of, id) and queries (of, qid): as ``once`` gives them. The ``limit`` best texts, equal
    scores by the id of their first rows, have the ``limit`` best rows, as each of their first rows comes before all rows of the texts behind."""
    if rows is not None:
        found = top(found.select("qid", F.col("id").alias("of"), "score").join(rows, "of").select("qid", "id", "score"), limit)
    return found if queries is None else found.withColumnRenamed("qid", "of").join(queries, "of").select("qid", "id", "score", "rank")


def bm25_lane(queries: DataFrame, memories: DataFrame, limit: int = 50) -> DataFrame:
    """BM25 over rows with a term; document counts and lengths are those of the rows given. queries: qid, text.

    Rows are counted once for all blocks of queries. Scoring is ``scored_by_terms``: frequent
    terms, which nearly every query shares with nearly every row, are never joined. Where many texts are copies, each is taken apart, counted and scored once, for
    all rows and queries that have it."""
    texts, rows_of = once(memories, "id", "content", limit)
    questions, queries_of = once(queries, "qid", "text")
    docs = _with_terms(texts.select(F.struct("id", "copies").alias("key"), "content"), "key", "content").select("key.id", "key.copies", "terms", "counts", "length")
    docs = kept(docs, "bm25-terms")  # made once: counted, then scored for each block of queries
    n_docs, length = docs.agg(F.sum("copies"), F.sum(F.col("length") * F.col("copies")) / F.sum("copies")).first()
    asked = kept(_with_terms(questions, "qid", "text").select("qid", "terms"), "bm25-asked")
    counted = kept(docs.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df")), "bm25-counts")

    def idf(vocabulary: Broadcast) -> np.ndarray:
        names = vocabulary.value[0]  # the terms of a block of queries
        told = docs.sparkSession.createDataFrame(pa.table({"term": names, "at": np.arange(len(names))})).join(counted, "term").select("at", "df").toArrow()
        df = np.zeros(len(names))
        df[told.column("at").to_numpy()] = told.column("df").to_numpy()
        return np.log((n_docs - df + 0.5) / (df + 0.5) + 1)

    if not n_docs:
        return scored_by_terms(asked.limit(0), docs, idf, lambda tf, size: tf, limit)
    return for_each(scored_by_terms(asked, docs, idf, lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / length)), limit), rows_of, queries_of, limit)


def scored_by_terms(asked: DataFrame, docs: DataFrame, idf: Callable[[Broadcast], np.ndarray], weight: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int) -> DataFrame:
    """The rows with the largest sums of idf * weight over the terms that they share with a query. asked: qid, terms (distinct); docs: id, terms (distinct) and, where
    a row may have a term more than once, counts and length; idf: of the terms of a block of queries, from a broadcast whose first part is their array; weight: of how often a row has a term and how many it has in all.

    Queries are broadcast a block at a time, as the list of queries of each term, in groups of queries of like terms; a task adds up its rows' weights over
    those lists and sends on only the best of each step and query. Sums are made in single precision first; only pairs that can be results
    by these are summed in double precision."""
    context = docs.sparkSession.sparkContext
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    found = []
    n_docs = docs.count()
    for part in _parts(asked.where(F.size("terms") > 0), F.size("terms")):
        block = part.toArrow().combine_chunks()
        if not block.num_rows:
            continue
        held = context.broadcast(_grouped(block))
        sent = context.broadcast(idf(held))

        def scored(batches: Iterator[pa.RecordBatch], least: np.ndarray, held=held, sent=sent) -> Iterator[pa.RecordBatch]:
            words, qids, guide, centres, lists_of = held.value
            for batch in (part for whole in batches for part in _term_slices(whole)):
                doc, term, tf, size = _counted(batch, words)  # once a batch: the block's terms are hashed each time
                value = sent.value[term] * weight(tf, size)
                order, doc, term, value = _like_together(doc, term, value, batch.num_rows, guide, centres)
                ids = batch.column("id").take(pa.array(order))
                for at in range(0, batch.num_rows, STEP_ROWS):
                    lo, hi = np.searchsorted(doc, [at, at + STEP_ROWS])
                    yield _scores_of_step(doc[lo:hi] - at, term[lo:hi], value[lo:hi], lists_of, ids.slice(at, STEP_ROWS), qids, limit, least)

        def run(batches: Iterator[pa.RecordBatch], scored=scored, held=held, known=None) -> Iterator[pa.RecordBatch]:
            qids = held.value[1]
            least = np.full(len(qids), -np.inf) if known is None else known.value.copy()
            return _trimmed(scored(batches, least), limit, len(qids), (qids, least))

        rows = docs.select("id", "terms", *(c for c in ("counts", "length") if c in docs.columns))
        if n_docs * block.num_rows >= FIRST_PAIRS:
            # a part of the rows has results whose last score bounds that of all, so the others' tasks send little on
            early = F.pmod(F.xxhash64("id"), F.lit(FIRST_PART)) == 0
            start = kept(top(rows.where(early).mapInArrow(run, schema), limit).select("qid", "id", "score", "rank"), "first-results")
            last = start.where(F.col("rank") == limit).select("qid", "score").toArrow().combine_chunks()
            qids = held.value[1]
            least = np.full(len(qids), -np.inf)
            if last.num_rows:
                least[pc.index_in(last.column("qid"), qids).to_numpy()] = last.column("score").to_numpy()
            known = context.broadcast(least)
            found += [start.drop("rank"), rows.where(~early).mapInArrow(lambda batches, run=run, known=known: run(batches, known=known), schema)]
        else:
            found.append(rows.mapInArrow(run, schema))
    return top(reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema), limit)


#: Rows and queries of a step; what a multiplied pair costs of a pair that is added by itself; terms that are multiplied at most.
STEP_ROWS, GROUP, PAIR_SHARE, STEP_TERMS = 256, 2048, 1 / 600, 2048
#: Groups of like rows and queries, the frequent terms that tell them, and rounds to find them.
LIKE, LIKE_TERMS, LIKE_ROUNDS = 8, 128, 5


def _grouped(block: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block of queries (qid, terms) in groups of like ones: its terms; the ids, group after group; the place of each term among the frequent ones
    (others: -1) and the centres of the groups over these; the bounds of the groups, where each group's queries of each term begin in the list of queries by
    term, and this list."""
    lists = block.column("terms").chunk(0)
    coded = lists.flatten().dictionary_encode()
    n, code = len(lists), coded.indices.to_numpy().astype(np.int64)
    query, many = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), np.bincount(code, minlength=len(coded.dictionary))
    often = np.argsort(-many, kind="stable")[:LIKE_TERMS]
    guide = np.full(len(many), -1)
    guide[often] = np.arange(len(often))
    x = _directions(query, guide[code], n, len(often))
    centres = x[:1]
    while len(centres) < min(LIKE, n):  # the query that is least like all centres is the next one
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(LIKE_ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[near == k].sum(axis=0) for k in range(len(centres))])
        centres = np.divide(sums, np.linalg.norm(sums, axis=1, keepdims=True), out=centres.copy(), where=sums.any(axis=1, keepdims=True))
    near = (x @ centres.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by_term = np.lexsort((place[query], code))
    code, query = code[by_term], place[query][by_term]
    bounds = np.cumsum(np.bincount(near, minlength=len(centres)))
    cuts = np.unique(np.concatenate([[0], bounds, *(np.arange(lo, hi, GROUP) for lo, hi in zip(np.append(0, bounds[:-1]), bounds, strict=True))]).astype(np.int64))
    starts = np.array([np.searchsorted(code * n + query, np.arange(len(many)) * n + cut) for cut in cuts]).astype(np.int32)
    return coded.dictionary, block.column("qid").chunk(0).take(pa.array(order)), guide, centres, (cuts, starts, query.astype(np.int32))


def _directions(row: np.ndarray, place: np.ndarray, rows: int, places: int) -> np.ndarray:
    """Which of the frequent terms each row has, as a vector of length 1 or 0."""
    x = np.zeros((rows, places), np.float32)
    x[row[place >= 0], place[place >= 0]] = 1
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)


def _like_together(doc: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, guide: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of a batch in the order of the centres that they are nearest to, and their terms in this order."""
    near = (_directions(doc, guide[term], rows, centres.shape[1]) @ centres.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    by_row = np.argsort(place[doc], kind="stable")
    return order, place[doc][by_row], term[by_row], value[by_row]


def _scores_of_step(doc: np.ndarray, term: np.ndarray, value: np.ndarray, lists_of: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pa.Array, qids: pa.Array, limit: int, least: np.ndarray) -> pa.RecordBatch:
    """What may be among the best rows of each query, of a step's rows with their (doc, term, value), rounded to 9 digits, as the order of the sum must not break ties.
    least: what a result must score, as far as is known."""
    cuts, starts, of = lists_of
    rows, n = len(ids), len(qids)
    summed = lambda: _best(_added(doc, term, value, np.append(starts[0], len(of)), of, rows, n), ids, qids, limit, least=least, digits=9, above=0.0)
    if not np.isfinite(least).any():
        return summed()
    words, at, held = np.unique(term, return_inverse=True, return_counts=True)
    begin = starts[:, words]
    total, made, rare = np.empty((rows, n), np.float32), [], []
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        many = begin[k + 1] - begin[k]
        # a term that many rows and queries have is a column of a matrix; others are added pair by pair
        both = held * many
        dense = np.flatnonzero(both > rows * (hi - lo) * PAIR_SHARE)
        if len(dense) > STEP_TERMS:
            dense = dense[np.argsort(-both[dense], kind="stable")[:STEP_TERMS]]
        column = np.where(many > 0, -1, -2)
        column[dense] = np.arange(len(dense))
        place = column[at]
        inside, rest = np.flatnonzero(place >= 0), np.flatnonzero(place == -1)
        x, y = np.zeros((rows, len(dense))), np.zeros((hi - lo, len(dense)), np.float32)
        x[doc[inside], place[inside]] = value[inside]
        y[of[_spans(begin[k, dense], many[dense])] - lo, np.repeat(np.arange(len(dense), dtype=np.int32), many[dense])] = 1
        total[:, lo:hi] = x.astype(np.float32) @ y.T
        made.append((lo, hi, x, y))
        rare.append((doc[rest] * n, begin[k, at[rest]], many[at[rest]], value[rest]))
    row, first, many, alone = (np.concatenate(c) for c in zip(*rare, strict=True))
    key, added, total = np.repeat(row.astype(np.int32), many) + of[_spans(first, many)], np.repeat(alone, many), total.reshape(-1)
    np.add.at(total, key, added.astype(np.float32))
    # sums of so many numbers above 0 are off by this share at most
    share = (np.bincount(doc, minlength=1).max() + 8) * 2.0**-23
    bound = np.maximum((least - ROOM) * (1 - share), np.finfo(np.float32).tiny) * (1 - 2.0**-22)
    some = np.flatnonzero((total.reshape(rows, n) >= bound.astype(np.float32)).reshape(-1))
    if len(some) > total.size / 32:
        return summed()
    row, query = np.divmod(some, n)
    wanted = np.zeros(total.size, bool)
    wanted[some] = True
    meant = np.flatnonzero(wanted[key])
    exact = np.bincount(np.searchsorted(some, key[meant]), added[meant], len(some)).astype(np.float64)
    for lo, hi, x, y in made:
        mine = np.flatnonzero((query >= lo) & (query < hi))
        for few in (mine[k : k + STEP_ROWS] for k in range(0, len(mine), STEP_ROWS)):
            exact[few] += np.einsum("ij,ij->i", x[row[few]], y[query[few] - lo])
    exact = np.round(exact, 9)
    good = np.flatnonzero((exact > 0) & (exact >= least[query]))
    return pa.RecordBatch.from_arrays([qids.take(pa.array(query[good])), ids.take(pa.array(row[good])), pa.array(exact[good])], names=["qid", "id", "score"])


def _spans(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1 and so on, many[k] of them, for each k."""
    return np.repeat((start - (np.cumsum(many) - many)).astype(np.int32), many) + np.arange(many.sum(), dtype=np.int32)


#: A term of more than a share of the queries is multiplied as a row of a matrix, the so many most frequent ones; others are added up one by one.
DENSE_SHARE, DENSE_TERMS = 1 / 12, 512


def _often(first: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each frequent term (others: -1), and a matrix with a row for each of them and a column for each query."""
    many = np.diff(first)
    terms = np.flatnonzero(many > max(8, n * DENSE_SHARE))
    terms = terms[np.argsort(-many[terms], kind="stable")][:DENSE_TERMS]
    place, has = np.full(len(many), -1), np.zeros((len(terms), n))
    place[terms] = np.arange(len(terms))
    for k, t in enumerate(terms.tolist()):
        has[k, of[first[t] : first[t + 1]]] = 1
    return place, has


def _added(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, first: np.ndarray, of: np.ndarray, rows: int, n: int, often: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """rows x n sums of the weights of (doc, term) over the queries of[first[term]:first[term + 1]] of each term. often: what ``_often`` gives."""
    place, has = often or _often(first, of, n)
    column = place[term]
    dense = column >= 0
    x = np.zeros((rows, len(has)))
    x[doc[dense], column[dense]] = weight[dense]
    total = (x @ has).reshape(-1)
    rare = np.flatnonzero(~dense)
    many = first[term[rare] + 1] - first[term[rare]]
    # as many terms at once as have about STEP_VALUES queries together, or half as many as there are sums, as each turn goes through these
    room = max(STEP_VALUES, len(total) // 2)
    cuts = np.unique([0, *np.searchsorted(np.cumsum(many), np.arange(room, many.sum(), room)), len(rare)])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at, m = rare[lo:hi], many[lo:hi]
        where = np.repeat(first[term[at]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        total += np.bincount(np.repeat(doc[at], m) * n + of[where], np.repeat(weight[at], m), len(total))
    return total.reshape(rows, n)


def _term_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(batch, pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64), TERM_VALUES)


def _counted(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often, terms of the row in all) of the terms of ``vocabulary`` in each row's list of distinct terms."""
    lists = batch.column("terms")
    many = pc.list_value_length(lists).to_numpy()
    term = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    some = np.flatnonzero(term >= 0)
    doc = np.repeat(np.arange(len(lists)), many)[some]
    if "counts" in batch.schema.names:
        return doc, term[some], batch.column("counts").flatten().to_numpy()[some], batch.column("length").to_numpy()[doc]
    return doc, term[some], np.ones(len(some), np.int64), many[doc]


DAY_MS = 86_400_000


def _ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def _first_of_day(rows: DataFrame, kind: str, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each day, cut before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("place").withColumn("kind", F.lit(kind))


def _asked_days(queries: DataFrame, reach_ms: int) -> DataFrame:
    """A row for each UTC day that a query's widened range touches: before or after its range, inside, or an edge of it."""
    q = queries.where("from is not null and to is not null").select("qid", _ms("from").alias("first"), _ms("to").alias("last"))
    day = lambda c: F.floor(c / DAY_MS)
    q = q.where(F.col("first") <= F.col("last") + 2 * reach_ms).withColumn("day", F.explode(F.sequence(day(F.col("first") - reach_ms), day(F.col("last") + reach_ms))))
    start, end = F.col("day") * DAY_MS, F.col("day") * DAY_MS + (DAY_MS - 1)
    kind = F.when(end < F.col("first"), "before").when(start > F.col("last"), "after").when((start >= F.col("first")) & (end <= F.col("last")), "inside").otherwise("edge")
    return q.withColumn("kind", kind)


def temporal_lane(queries: DataFrame, memories: DataFrame, tau_days: float = 7.0, limit: int = 50) -> DataFrame:
    """Rows by the distance of their event_date to the query's range (from, to; to the millisecond), as exp(-days / tau). queries: qid, from,
    to. With tau 0: rows in the range, most recent first, by place.

    Rows are keyed by their UTC day and queries are exploded over the days of their range, so the join is one of equal days. Of a day before the
    range only its last ``limit`` rows can be results, of a day after it the first ones, and of a day inside those of the smallest
    ids; only the days in which a range begins or ends are joined whole, and trimmed. Each range is asked once, for all queries that have it. Queries without a date have no
    rows."""
    asked = queries.select("qid", F.col("from").alias("__from"), F.col("to").alias("__to")).where("__from is not null and __to is not null")
    ranges = asked.select(F.struct("__from", "__to").alias("qid"), F.col("__from").alias("from"), F.col("__to").alias("to")).distinct()
    found = _near_ranges(ranges, memories, tau_days, limit).select(F.col("qid.__from").alias("__a"), F.col("qid.__to").alias("__b"), "id", "score", "rank")
    return asked.join(found, (F.col("__from") == F.col("__a")) & (F.col("__to") == F.col("__b"))).select("qid", "id", "score", "rank")


def _near_ranges(queries: DataFrame, memories: DataFrame, tau_days: float, limit: int) -> DataFrame:
    rows = memories.where("event_date is not null").select("id", _ms("event_date").alias("at"), "created_at").withColumn("day", F.floor(F.col("at") / DAY_MS))
    if tau_days <= 0:
        return _in_range(_asked_days(queries, 0), rows, limit)
    lists = [_first_of_day(rows, "before", limit, F.desc("at"), F.col("id")), _first_of_day(rows, "after", limit, F.col("at"), F.col("id")), _first_of_day(rows, "inside", limit, F.col("id")), rows.withColumn("kind", F.lit("edge"))]
    held = reduce(DataFrame.unionByName, lists).select("id", "at", "day", "kind")
    reach = int(3 * tau_days) * DAY_MS
    pairs = _asked_days(queries, reach).join(held, ["day", "kind"]).where((F.col("at") >= F.col("first") - reach) & (F.col("at") <= F.col("last") + reach))
    far = F.greatest(F.lit(0), F.col("first") - F.col("at"), F.col("at") - F.col("last")) / F.lit(float(DAY_MS))
    return top(pairs.select("qid", "id", F.exp(-far / tau_days).alias("score")).where("score > 0.01"), limit)


def _in_range(asked: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The rows in each query's range, most recent first: score 1 - place / rows in the range, which are counted by day."""
    recent = (F.desc("created_at"), F.desc("id"))
    held = _first_of_day(rows, "inside", limit, *recent).unionByName(rows.withColumn("kind", F.lit("edge")))
    pairs = asked.join(held, ["day", "kind"]).where((F.col("at") >= F.col("first")) & (F.col("at") <= F.col("last")))
    whole = asked.where("kind = 'inside'").join(rows.groupBy("day").agg(F.count("*").alias("rows")), "day").select("qid", "rows")
    # what a day keeps of its rows is not what it has: edges count their rows, days inside come with their numbers
    edge = pairs.where("kind = 'edge'").groupBy("qid").agg(F.count("*").alias("rows"))
    n = whole.unionByName(edge).groupBy("qid").agg(F.sum("rows").alias("n"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*recent))
    best = pairs.withColumn("rank", place).where(F.col("rank") <= limit).join(n, "qid")
    return best.select("qid", "id", (1 - (F.col("rank") - 1) / F.col("n")).alias("score"), "rank")


def graph_seeds(queries: DataFrame, memories: DataFrame, vector_hits: DataFrame, importance: float = 0.8, limit: int = 20, from_vectors: int = 5) -> DataFrame:
    """(qid, id, mass): important memories that hold a term of the query, then the query's best vector hits."""
    # short terms come first, as most texts hold one; queries are dealt out by hand, as few bytes of them take long
    terms = F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: F.length(t) > 0)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), lambda x: x["t"])
    q = queries.select("qid", "text").repartition(4 * queries.sparkSession.sparkContext.defaultParallelism).select("qid", terms.alias("terms"))
    high = memories.where(F.col("importance") >= importance).orderBy(F.desc("importance"), F.desc("updated_at"), F.desc("id")).limit(limit).select("id", "importance", F.lower("content").alias("low"))
    named = F.broadcast(high).join(q, F.exists("terms", lambda t: F.col("low").contains(t))).select("qid", "id", F.col("importance").alias("mass"), F.lit(0).alias("turn"))
    hits = vector_hits.where(F.col("rank") <= from_vectors).select("qid", "id", F.greatest("score", F.lit(0.05)).alias("mass"), F.lit(1).alias("turn"))
    return named.unionByName(hits).groupBy("qid", "id").agg(F.min_by("mass", "turn").alias("mass"))


def slot_boost(query: Column, subject: Column, attribute: Column, content: Column, terms: Column | None = None) -> Column:
    """How far a query names a memory's slot: 0.3 for its subject, 0.25 for a part of its attribute, 0.45 times the share of the query's
    terms in its content; names are looked for as parts of the query's text. terms: the query's content terms, where they are made already."""
    asked, held = content_terms(query) if terms is None else terms, content_terms(content)
    low = F.lower(query)
    parts = F.filter(F.split(F.lower(attribute), r"[^\p{L}\p{N}]+"), lambda p: F.length(p) >= 3)
    shared = F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1))
    by_subject = F.when((F.length(subject) > 0) & low.contains(F.lower(subject)), 0.3).otherwise(0.0)
    by_part = F.when(F.coalesce(F.exists(parts, lambda p: low.contains(p)), F.lit(False)), 0.25).otherwise(0.0)
    return F.least(by_subject + by_part + 0.45 * shared, F.lit(1.0))


# The wordings that tell what a question asks for. Those marked "first" count at its beginning only.
SYNTHESIS = ("all", "every", "list", "summarise", "summarize", "summary", "overall", "in general")
TEMPORAL_FIRST = ("when", "how long", "what date", "what day", "what month", "what year")
TEMPORAL = ("before or after", "earlier than", "later than", "most recent", "previously", "currently")
SPANS = ("year", "month", "week", "spring", "summer", "autumn", "fall", "winter")
FACT_FIRST = ("who", "what", "where", "which", "do", "does", "did", "is", "are", "was", "were", "has", "have", "had")
HOW_FIRST = ("many", "much", "old", "does", "did", "is", "are")
INTENTS = (
    ("synthesis", (), SYNTHESIS),
    ("temporal", TEMPORAL_FIRST, (*TEMPORAL, *(f"{near} {span}" for near in ("last", "next") for span in SPANS))),
    ("single_fact", (*FACT_FIRST, *(f"how {word}" for word in HOW_FIRST)), ()),
)


def intent(query: Column) -> Column:
    """single_fact, temporal, multi_hop or synthesis: the first of INTENTS with a wording that a question has, as whole words."""
    said = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(query), r"\W+"), lambda w: w != ""), " "), F.lit(" "))
    out = F.lit("multi_hop")
    for name, first, anywhere in reversed(INTENTS):
        tests = [said.startswith(f" {w} ") for w in first] + [said.contains(f" {w} ") for w in anywhere]
        out = F.when(reduce(lambda a, b: a | b, tests), name).otherwise(out)
    return out


def strategy(kind: Column) -> Column:
    return F.when(kind == "single_fact", "precision").when(kind == "temporal", "balanced").otherwise("recall")


def associations(fresh: DataFrame, memories: DataFrame, most: int = 3, least: float = 0.6) -> DataFrame:
    """Edges of new rows to the nearest rows of their namespace that came before them. fresh and memories: id, namespace_id,
    created_at, embedding."""
    return _near_in_namespace(fresh, memories, most, least, earlier=True)


def synonyms(names: DataFrame, known: DataFrame, least: float = 0.88) -> DataFrame:
    """The nearest known name of each new one inside its namespace, if it is near enough. Both: id, namespace_id, embedding."""
    return _near_in_namespace(names, known, 1, least).drop("rank")


def _near_in_namespace(queries: DataFrame, rows: DataFrame, limit: int, least: float, earlier: bool = False) -> DataFrame:
    """(qid, id, score, rank): the rows of a query's namespace with a cosine (of 9 digits) of ``least`` and more, best first; earlier: rows that came before it by
    created_at and id, else all but itself. Queries are broadcast a block at a time, and a task multiplies its rows of a namespace with
    the block's queries of it."""
    at = (F.unix_micros(F.col("created_at").cast("timestamp")) if earlier else F.lit(0).cast("long")).alias("at")
    held = lambda d: d.where("embedding is not null and namespace_id is not null").select("id", F.col("namespace_id").cast("string").alias("space"), at, "embedding")
    q, m = held(queries).withColumnRenamed("id", "qid"), held(rows)
    schema = f"qid {q.schema['qid'].dataType.simpleString()}, id {m.schema['id'].dataType.simpleString()}, score double"
    found = []
    for part in _parts(q, F.size("embedding")):
        block = part.toArrow().combine_chunks()
        if block.num_rows:
            sent = rows.sparkSession.sparkContext.broadcast(block.sort_by("space").combine_chunks())
            found.append(m.mapInArrow(_near_rows(sent, limit, least, earlier), schema))
    return top(reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema), limit)


def _near_rows(sent: Broadcast, limit: int, least: float, earlier: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def moments(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        column = rows.column("at")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return pc.fill_null(column, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        qids, vectors = (asked.column(c).combine_chunks() for c in ("qid", "embedding"))
        q, q_norm = _matrix(vectors, int(np.diff(vectors.offsets.to_numpy()).max()))
        born, bound = moments(asked), np.full(len(q), float(least))
        spaces = asked.column("space").combine_chunks().dictionary_encode()
        first = np.searchsorted(spaces.indices.to_numpy(), np.arange(len(spaces.dictionary) + 1))

        def scored() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                space = pc.fill_null(pc.index_in(batch.column("space"), spaces.dictionary), -1).to_numpy(zero_copy_only=False)
                for k in np.unique(space[space >= 0]).tolist():
                    lo, hi = int(first[k]), int(first[k + 1])
                    mine = batch.take(pa.array(np.flatnonzero(space == k)))
                    step = max(limit, STEP_VALUES // (hi - lo))
                    for at in range(0, mine.num_rows, step):
                        yield scores_of(mine.slice(at, step), lo, hi)

        def scores_of(rows: pa.RecordBatch, lo: int, hi: int) -> pa.RecordBatch:
            ids, names = rows.column("id"), qids.slice(lo, hi - lo)
            scores = _cosines(*_matrix(rows.column("embedding"), q.shape[1]), q[lo:hi], q_norm[lo:hi])
            if earlier:
                known = moments(rows)
                later = known[:, None] > born[None, lo:hi]
                row, query = np.nonzero(known[:, None] == born[None, lo:hi])
                later[row, query] = ~pc.less(ids.take(pa.array(row)), names.take(pa.array(query))).to_numpy(zero_copy_only=False).astype(bool)
                scores[later] = -np.inf
            else:
                own = pc.fill_null(pc.index_in(ids, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.flatnonzero(own >= 0)
                scores[row, own[row]] = -np.inf
            return _best(scores, ids, names, limit, least=bound[lo:hi], digits=9)

        return _trimmed(scored(), limit, len(q), (qids, bound))

    return run
