"""Repeated passages by MinHash banding over paragraphs.

A text is cut into short paragraphs whose ends depend on nearby words alone: a sentence or line of at least
``MIN_WORDS`` words is a block, neighbouring shorter ones are one together, and a block of more than ``LONG_WORDS`` words is cut
after every word whose hash is the least of the ``CUT_REACH`` words on either side, all inside the block. A passage put into any
text keeps its inner paragraphs, with or without sentence marks. Then:

1. paragraphs are brought to one row each (hash, first and last document, min-hashes of the 5-word shingles);
   those in several documents are repeats, and those that share a min-hash with a different paragraph
   are candidates. Bands of one min-hash each are enough here, because unrelated texts share no 5-word shingle;
2. a bitmap of these paragraphs, sized to their number up to a bound, is broadcast, and a second pass over the texts keeps only
   their places and shingles (a wrong bit costs a row, never a result: exact joins follow);
3. candidates are banded again, more strictly, and colliding ones verified by exact Jaccard similarity in the
   task; a group gives spanning links, never its pairs, and a large group is dealt out in slices;
4. classes are the components of the links; places whose class is in several documents and that lie side
   by side for ``MIN_PASSAGE`` words are removals, except for the first place of a class.

Equal paragraphs are those equal in two independent 64-bit hashes of their words. A paragraph of fewer words than a shingle is
too short to be told from chance; it leaves a gap of less than ``MAX_GAP`` words inside a passage, which is bridged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, steps, table
from .graph import components, local_roots
from .tokens import SLICE_BYTES, WORD_GAP, gram_hash, mix, words

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
MIN_WORDS = 8
LONG_WORDS = 24
CUT_REACH = 4
#: A removal has at least so many words; the gap that may lie between two of its paragraphs.
MIN_PASSAGE = 20
MAX_GAP = 8
#: Bits of the bitmap for each paragraph in it, and the bounds of its size: 128 KB and 32 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 28
SLICE_ROWS = 2048
#: A key with more than this share of all rows is joined by broadcast (there are fewer such keys than its inverse), not shuffled.
HOT_SHARE = 1 / 1024
#: Keys of documents without an id, made from their texts, lie at and above this number (or begin with this character).
NAMELESS, NAMELESS_TEXT = 1 << 62, "\uffff"


def tune_bands(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` min-hashes that find a pair of the given similarity with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


FIRST_BANDS = tune_bands(1)
STRICT_ROWS = 3
STRICT_BANDS = tune_bands(STRICT_ROWS)


def _least_nearby(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Words of a hash under those of the CUT_REACH words on either side, where all of these are in the word's own block."""
    n, r = len(h), CUT_REACH
    out = np.zeros(n, bool)
    if n > 2 * r:
        mid = h[r : n - r]
        least = block[: n - 2 * r] == block[2 * r :]
        for j in range(2 * r + 1):
            if j != r:
                least &= mid < h[j : n - 2 * r + j]
        out[r : n - r] = least
    return out


class Paragraphs:
    """The paragraphs of at least SHINGLE words of some texts.

    Of a slice of a long text (``more``: the text goes on behind it) only those whose ends can't change; ``rest`` is then the first
    byte of what must be read again. inside: the text begins within a block of over LONG_WORDS, and so many words (lead) after the
    beginning of its sentence."""

    def __init__(self, texts: list[bytes], more: bool = False, inside: bool = False, lead: int = 0) -> None:
        w = words(texts)
        self.words, n = w, len(w.hash)
        self.rest, self.inside, self.lead = 0, inside, lead
        if not n:
            self.doc = self.start = self.size = self.hash = self.check = self.first_byte = self.last_byte = np.zeros(0, np.int64)
            self.shingle, self.shingle_at = np.zeros(0, np.uint64), np.zeros(1, np.int64)
            return
        ends = np.isin(w.data, np.frombuffer(b".!?\n", np.uint8))
        seen = np.r_[0, np.cumsum(ends, dtype=np.int32)]
        following = np.r_[w.start[1:], len(w.data)]
        last_of_doc = np.r_[w.doc[1:] != w.doc[:-1], True]
        stop = (seen[following] > seen[w.end]) | last_of_doc
        sentence = np.r_[0, np.cumsum(stop)[:-1]]
        lengths = np.bincount(sentence)
        lengths[0] += lead
        long = lengths >= MIN_WORDS
        next_long = np.r_[long[1:], True]
        cut = stop & (long[sentence] | next_long[sentence] | last_of_doc)
        block = np.r_[0, np.cumsum(cut)[:-1]]
        end = n
        if more:  # the last sentence goes on; short ones before it may be joined with it
            last = int(sentence[-1])
            certain = last - 1 if long[last] or last and long[last - 1] else last - 2
            end = n if long[last] else int(np.searchsorted(sentence, certain + 1))
        long_block = np.bincount(block[:end], minlength=int(block[-1]) + 1) > LONG_WORDS
        long_block[0] |= inside
        inner = _least_nearby(w.hash, block) & long_block[block]
        sure = n
        if more:
            at = np.flatnonzero((cut & (sentence <= certain)) | (inner & (np.arange(n) + CUT_REACH < end)))
            sure = int(at[-1]) + 1 if len(at) else 0
            self.rest = int(w.start[sure]) if sure < n else len(texts[0])
            self.inside = bool(sure and not cut[sure - 1]) if sure else inside
            begun = int(np.searchsorted(sentence, sentence[sure - 1])) if sure else 0
            self.lead = (sure - begun + (lead if begun == 0 else 0)) if self.inside and sure and not stop[sure - 1] else 0
        cut |= inner
        block = np.r_[0, np.cumsum(cut)[:-1]]
        size = np.bincount(block)
        first = np.cumsum(size) - size
        kept = (size >= SHINGLE) & (first + size <= sure)
        # shingles lie wholly inside a kept paragraph
        at = np.arange(max(0, n - SHINGLE + 1))
        at = at[(block[at] == block[at + SHINGLE - 1]) & kept[block[at]]]
        self.shingle = gram_hash(w.hash, at, SHINGLE)
        number = np.cumsum(kept) - 1
        of = number[block[at]]
        self.shingle_at = np.searchsorted(of, np.arange(int(kept.sum()) + 1))
        self.start, self.size = first[kept], size[kept]
        self.doc = w.doc[self.start]
        self.first_byte, self.last_byte = w.start[self.start], w.end[self.start + self.size - 1]
        place = (np.arange(n) - first[block]).astype(np.uint64)
        self.hash, self.check = (self._of_words(mix(w.hash + place * np.uint64(k))) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))

    def _of_words(self, of_word: np.ndarray) -> np.ndarray:
        total = np.zeros(len(of_word) + 1, np.uint64)
        np.cumsum(of_word, out=total[1:])
        return mix(total[self.start + self.size] - total[self.start]).view(np.int64)

    def min_hashes(self, count: int) -> list[np.ndarray]:
        return [np.minimum.reduceat(mix(self.shingle ^ np.uint64(0xA5A5A5A5 * (k + 1))), self.shingle_at[:-1]).view(np.int64) if len(self.hash) else np.zeros(0, np.int64) for k in range(count)]


def read(texts: list[bytes]) -> Iterator[tuple[Paragraphs, int, int]]:
    """The paragraphs of texts, those of a long text slice by slice: with the words and bytes before the slice."""
    if len(texts) != 1 or len(texts[0]) <= SLICE_BYTES:
        yield Paragraphs(texts), 0, 0
        return
    text, at, before, inside, lead, size = texts[0], 0, 0, False, 0, SLICE_BYTES
    while at < len(text):
        gap = WORD_GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.end() if gap else len(text)
        p = Paragraphs([text[at:end]], end < len(text), inside, lead)
        if end < len(text) and not p.rest:  # nothing is sure yet: read on
            size *= 2
            continue
        yield p, before, at
        if end == len(text):
            return
        before += int(np.searchsorted(p.words.start, p.rest))
        at, inside, lead, size = at + p.rest, p.inside, p.lead, SLICE_BYTES


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc, text): the id, or for rows without one a key made from the text, which comes after all ids."""
    id_, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        made = F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
        return docs.select(F.coalesce(id_.cast("long"), made).alias("doc"), "text")
    return docs.select(F.coalesce(id_.cast("string"), F.concat(F.lit(NAMELESS_TEXT), F.md5(text))).alias("doc"), "text")


def _distinct(docs: DataFrame) -> DataFrame:
    """A row per paragraph: piece, check, first_doc, last_doc, m0, m1, ... (its min-hashes)."""
    names = [f"m{k}" for k in range(FIRST_BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                for p, _, _ in read(texts):
                    ids = part.column("doc").take(pa.array(p.doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(p.hash), pa.array(p.check), *map(pa.array, p.min_hashes(FIRST_BANDS))], names=["doc", "piece", "check", *names])

    kind = docs.schema["doc"].dataType.simpleString()
    rows = docs.mapInArrow(run, f"doc {kind}, piece long, check long, {', '.join(f'{n} long' for n in names)}")
    return rows.groupBy("piece", "check").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), *(F.min(n).alias(n) for n in names))


def _marked(docs: DataFrame) -> DataFrame:
    """(piece, check, repeated, candidate): paragraphs of several documents, and those that share a min-hash with another."""
    one = _distinct(docs).withColumn("repeated", F.col("first_doc") != F.col("last_doc")).drop("first_doc", "last_doc")
    one = materialize(one, "distinct-paragraphs")
    bands = one.select("piece", F.explode(F.array(*[F.xxhash64(F.lit(k), f"m{k}") for k in range(FIRST_BANDS)])).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least <> most").select("bucket")
    near = bands.join(shared, "bucket", "left_semi").select("piece").distinct().withColumn("candidate", F.lit(True))
    found = one.select("piece", "check", "repeated").join(near, "piece", "left")
    return found.where("repeated or candidate").withColumn("candidate", F.coalesce("candidate", F.lit(False)))


def _bitmap(pieces: DataFrame) -> np.ndarray:
    """Bit (piece mod the bitmap's size) of every piece, as 64-bit words: at most 2**(MOST_BITS - 6) rows reach the driver."""
    bits = min(max(LEAST_BITS, (pieces.count() * BITS_EACH).bit_length()), MOST_BITS)
    low = F.col("piece").bitwiseAND(F.lit((1 << bits) - 1))
    got = pieces.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(piece & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if got.num_rows:
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _in(bits: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    low = pieces & (len(bits) * 64 - 1)
    return ((bits[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _places(docs: DataFrame, bitmap: np.ndarray, candidates: np.ndarray) -> DataFrame:
    """Places of the paragraphs in the bitmap: doc, piece, check, start and size in words, first and last byte, and the shingles of
    those that are in the bitmap of candidates."""
    held = docs.sparkSession.sparkContext.broadcast((bitmap, candidates))
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "piece", "check", "start", "size", "first_byte", "last_byte", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, near = held.value
        for batch in batches:
            for part, texts in steps(batch, "text"):
                for p, words_before, bytes_before in read(texts):
                    at = np.flatnonzero(_in(bits, p.hash))
                    doc = p.doc[at]
                    none = np.zeros(0, np.int64)
                    lists = [np.unique(p.shingle[p.shingle_at[i] : p.shingle_at[i + 1]]).view(np.int64) if c else none for i, c in zip(at.tolist(), _in(near, p.hash[at]).tolist(), strict=True)]
                    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                    shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
                    byte = bytes_before - np.r_[0, p.words.stop[:-1]][doc]
                    columns = [p.hash[at], p.check[at], p.start[at] - p.words.first[doc] + words_before, p.size[at], p.first_byte[at] + byte, p.last_byte[at] + byte]
                    yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(doc)), *map(pa.array, columns), shingles], names=names)

    return docs.mapInArrow(run, f"doc {kind}, piece long, check long, start long, size long, first_byte long, last_byte long, shingles array<long>")


def _verify(piece: np.ndarray, lists: list[np.ndarray], asks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one group: pairs of exact Jaccard similarity of at least ``similarity``. asks: 1 for rows that
    are held only against rows of 0; if there are none, all pairs are tried that aren't joined yet."""
    sizes = np.array([len(x) for x in lists])
    order = np.argsort(sizes, kind="stable")
    flat = np.concatenate([lists[i] for i in order])
    _, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(order)), sizes[order])
    by_shingle = np.argsort(flat, kind="stable")
    where = np.searchsorted(flat[by_shingle], np.arange(flat.max() + 2))
    sized, split = sizes[order], asks[order]
    begin = np.r_[0, np.cumsum(sized)]
    roots = np.arange(len(order))
    both = asks.max() > 0
    for i in range(1, len(order)):
        shared = np.zeros(i, np.int64)
        for s in flat[begin[i] : begin[i + 1]].tolist():
            others = owner[by_shingle[where[s] : where[s + 1]]]
            others = others[: np.searchsorted(others, i)]  # owners of a shingle are in order
            shared[others] += 1
        near = np.flatnonzero(shared >= similarity * (sized[:i] + sized[i] - shared) - 1e-9)
        near = near[split[near] != split[i]] if both else near
        if len(near):
            roots = local_roots(np.full(len(near), i), near, roots)
    a, b = piece[order], piece[order][roots]
    return a[a != b], b[a != b]


def _links(candidates: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between candidate paragraphs (piece, shingles), with the components of all links."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keys = []
            for b in range(STRICT_BANDS):
                key = np.zeros(len(lists), np.uint64)
                for r in range(STRICT_ROWS):
                    key = mix(key ^ np.minimum.reduceat(mix(flat ^ np.uint64(0xC2B2AE35 * (1 + b * STRICT_ROWS + r))), at[:-1]))
                keys.append(key.view(np.int64))
            grouped = pa.ListArray.from_arrays(pa.array((np.arange(len(lists) + 1) * STRICT_BANDS).astype(np.int32)), pa.array(np.column_stack(keys).ravel() if len(lists) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), grouped], names=["piece", "bands"])

    banded = candidates.mapInArrow(band, "piece long, bands array<long>").select("piece", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int"))
    held = banded.join(sizes, ["band", "key"]).withColumn("slice", F.expr("cast(pmod(xxhash64(piece), slices) as int)"))
    sent = held.select("piece", "band", "key", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    sent = sent.select("piece", "band", "key", F.least("slice", "other").alias("one"), F.greatest("slice", "other").alias("two"), (F.col("slice") > F.col("other")).cast("int").alias("asks"))
    keys = ["band", "key", "one", "two"]
    dealt = sent.join(candidates, "piece").repartition(*keys).sortWithinPartitions(*keys)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            block = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            got, rest = _whole_groups(block, keys)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _all_links(got, keys, similarity)], schema=schema)
        if rest is not None and rest.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _all_links(rest, keys, similarity)], schema=schema)

    return dealt.select(*keys, "asks", "piece", "shingles").mapInArrow(run, "a long, b long").distinct()


def _bounds(block: pa.Table, keys: list[str]) -> np.ndarray:
    k = np.column_stack([block.column(c).to_numpy().astype(np.int64) for c in keys])
    return np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(k)]


def _whole_groups(block: pa.Table, keys: list[str]) -> tuple[pa.Table, pa.Table]:
    """The whole groups of a sorted block, and the rows of the last, which may go on."""
    cut = int(_bounds(block, keys)[-2]) if block.num_rows else 0
    return block.slice(0, cut), block.slice(cut)


def _all_links(block: pa.Table, keys: list[str], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64),) * 2]
    if block.num_rows:
        piece, asks = block.column("piece").to_numpy(), block.column("asks").to_numpy()
        lists = block.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        bounds = _bounds(block, keys)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mixed = asks[lo:hi].min() != asks[lo:hi].max()
            same_slice = block.column("one")[lo].as_py() == block.column("two")[lo].as_py()
            if hi - lo > 1 and (mixed or same_slice):
                found.append(_verify(piece[lo:hi], [flat[at[i] : at[i + 1]] for i in range(lo, hi)], asks[lo:hi], similarity))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a row per key that holds n, its number of rows. Keys of more than HOT_SHARE of all rows are fewer than
    its inverse: their facts are broadcast, and only the rows of the others are shuffled."""
    facts = materialize(facts, "facts")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(facts.where(F.col("n") > max(1, total * HOT_SHARE)))
    others = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(facts, key)).drop("n")


def repeats(docs: DataFrame) -> DataFrame:
    """Places of repeated passages: doc, class_id, start, size (words), first_byte, last_byte, passage (its number in
    the document), removed (false for a class's first place). docs: doc (see ``with_keys``), text.

    Rows of one key are one document; null or wordless texts have no places. Word
    comparison ignores ASCII case and marks. An empty table gives an empty table."""
    marked = materialize(_marked(docs), "marked-paragraphs")
    candidates = marked.where("candidate").select("piece").distinct()
    places = materialize(_places(docs, _bitmap(marked), _bitmap(candidates)), "paragraph-places")
    # summed up before they meet the candidates, so that a frequent paragraph is a row per task
    near = places.where("size(shingles) > 0").groupBy("piece").agg(F.min("shingles").alias("shingles")).join(candidates, "piece", "left_semi")
    joined = components(_links(materialize(near, "paragraph-candidates"))).withColumnRenamed("node", "piece")
    classes = marked.join(joined, "piece", "left").where("repeated or component is not null").select("piece", "check", F.coalesce("component", "piece").alias("class_id"))
    sizes = places.groupBy("piece", "check").agg(F.count("*").alias("n"))
    key = F.xxhash64("piece", "check").alias("key")
    held = places.drop("shingles").select("*", key)
    own = _with_facts(held, classes.join(sizes, ["piece", "check"]).select(key, F.col("piece").alias("__p"), F.col("check").alias("__c"), "class_id", "n"), "key")
    own = own.where("piece = __p and check = __c").drop("key", "check", "__p", "__c").groupBy("doc", "start", "piece").agg(*[F.first(c).alias(c) for c in ("size", "first_byte", "last_byte", "class_id")])
    own = materialize(own, "own-places")
    spread = own.groupBy("class_id").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"))
    own = _with_facts(own, spread.withColumn("wide", F.col("least") != F.col("most")), "class_id").where("wide").drop("least", "most", "wide")
    along = Window.partitionBy("doc").orderBy("start", "piece")
    opens = F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("size")).over(along), F.lit(-(1 << 40))) > MAX_GAP
    own = own.withColumn("passage", F.sum(opens.cast("int")).over(along))
    run = Window.partitionBy("doc", "passage")
    own = own.withColumn("words", F.max(F.col("start") + F.col("size")).over(run) - F.min("start").over(run)).where(f"words >= {MIN_PASSAGE}")
    own = materialize(own, "passages")
    first = own.groupBy("class_id").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    out = _with_facts(own, first, "class_id").withColumn("removed", F.struct("doc", "start") != F.col("first"))
    return out.select("doc", "class_id", "start", "size", "first_byte", "last_byte", "passage", "removed", F.col("first.doc").alias("first_doc"))


def summary(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, component_id (the smallest doc_id that shared passages lead to, its own
    without any), n_repeats, repeat_words, n_removed, removed_words and repeated (has repeats).

    Rows of one doc_id are one document. Rows without an id are documents by their texts: they are searched like any other, lead
    only where no document has an id, and have then a null component_id. An empty table gives an empty table."""
    keyed = with_keys(docs)
    places = materialize(repeats(keyed), "repeated-passages")
    per_doc = places.groupBy("doc").agg(F.count("*").alias("n_repeats"), F.sum("size").alias("repeat_words"), F.sum(F.col("removed").cast("long")).alias("n_removed"), F.sum(F.when(F.col("removed"), F.col("size")).otherwise(F.lit(0))).alias("removed_words"))
    joined = components(places.select(F.col("doc").alias("a"), F.col("first_doc").alias("b")).distinct()).withColumnRenamed("node", "doc")
    out = with_keys(docs).drop("text").join(per_doc, "doc", "left").join(joined, "doc", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repeats", "repeat_words", "n_removed", "removed_words")]
    kind = docs.schema["doc_id"].dataType
    named = lambda c: F.when(c < F.lit(NAMELESS if keyed.schema["doc"].dataType.typeName() == "long" else NAMELESS_TEXT), c).cast(kind)
    return out.select(named(F.col("doc")).alias("doc_id"), named(F.coalesce("component", "doc")).alias("component_id"), *counts, F.col("n_repeats").isNotNull().alias("repeated"))


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))
