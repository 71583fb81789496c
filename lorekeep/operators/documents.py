"""Versioned documents: chunks, versions, heads and passage search."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_uuid, words_of
from ..scratch import kept
from . import fusion, retrieval

MAX_CHARS, OVERLAP = 1600, 200
#: Where a chunk may end: before a line feed or an ideographic full stop, after a full stop that a space follows.
BREAK, LINE_END = re.compile(r"\n|。|(?<=\.) "), re.compile(r"\n")


def _units(text: str) -> str:
    """The text as UTF-16 units, a character each."""
    return "".join(map(chr, memoryview(text.encode("utf-16-le")).cast("H"))) if any(c > "\uffff" for c in text) else text


def chunk_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(index, first byte, last byte, text) of the chunks; lengths count UTF-16 units.

    All places where a chunk may end are found first; a chunk takes the last of them in the final 40 per cent of its window, else the
    window's end (never within a pair of surrogates), and the next begins before that end by the overlap. Blank chunks are left out."""
    most = max(max_chars, 200)
    back = min(max(overlap, 0), most // 2)
    units = _units(text)
    stops = [(m.start(), m.end()) for m in BREAK.finditer(units)]
    ends = [e for _, e in stops]
    pieces, start, total = [], 0, len(units)
    while start < total:
        end = start + most
        if end < total:
            last = bisect_right(ends, end) - 1
            # the stop that ends a sentence belongs to its break: a window that starts on the space after it doesn't hold it whole
            if last >= 0 and stops[last][0] - (units[stops[last][0]] == " ") >= start + most * 3 // 5:
                end = stops[last][0]
            end -= "\udc00" <= units[end] <= "\udfff"
        pieces.append((start, min(end, total)))
        if end >= total:
            break
        start = max(start + 1, end - back)
        start += "\udc00" <= units[start] <= "\udfff"
    out, at, byte = [], 0, 0
    plain = lambda a, b: units[a:b].encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    for a, b in pieces:
        byte, at = byte + len(plain(at, a).encode()), a
        part = plain(a, b)
        if part.strip():
            out.append((len(out), byte, byte + len(part.encode()), part))
    return out


def chunks(docs: DataFrame, id_: str = "document_id", text: str = "content", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """A row per chunk: id, chunk_index, first_byte, last_byte, content, content_hash. A null text has none. A task holds the chunks of a few megabytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in retrieval.text_slices(whole, "text")):
            found = [(row, *c) for row, t in enumerate(batch.column("text").to_pylist()) if t is not None for c in chunk_text(t, max_chars, overlap)]
            row, *columns = zip(*found, strict=True) if found else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_, "chunk_index", "first_byte", "last_byte", "content"])

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{id_} {kind}, chunk_index long, first_byte long, last_byte long, content string")
    return out.withColumn("content_hash", F.sha2("content", 256))


def version_hash(content: Column, **parts: Column) -> Column:
    """SHA-256 of the canonical JSON (keys in order, nulls dropped) of the content's hash and the given parts."""
    fields = {"contentHash": F.sha2(content, 256), **parts}
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "true"}), 256)


def with_versions(docs: DataFrame) -> DataFrame:
    """docs: namespace_id, source_key, content, metadata (text), updated_at. Adds version_hash and document_id; equal
    versions of a source are one row, the earliest."""
    rows = docs.withColumn("version_hash", version_hash(F.col("content"), metadata=F.col("metadata")))
    rows = rows.withColumn("document_id", stable_uuid(F.concat_ws("\0", "namespace_id", "source_key", "version_hash")))
    return take_first(rows, ["namespace_id", "source_key", "version_hash"], [F.col("updated_at"), F.col("document_id")])


def take_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def heads(versions: DataFrame) -> DataFrame:
    """The current version of each source: the last by updated_at (then by document_id)."""
    return versions.groupBy("namespace_id", "source_key").agg(F.max_by("document_id", F.struct("updated_at", "document_id")).alias("document_id"), F.max("updated_at").alias("updated_at"))


def current_documents(versions: DataFrame) -> DataFrame:
    return versions.join(heads(versions), "document_id", "left_semi")


def purge_source(versions: DataFrame, keys: DataFrame) -> DataFrame:
    return versions.join(keys.select("namespace_id", "source_key"), ["namespace_id", "source_key"], "left_anti")


def with_neighbours(hits: DataFrame, chunk_rows: DataFrame, reach: int = 1, id_: str = "document_id") -> DataFrame:
    """The chunks within ``reach`` of each hit, found by equal positions and not by a range join. hits: qid, id, score."""
    reach = max(0, min(reach, 2))
    near = hits.select("qid", id_, "score", F.col("chunk_index").alias("hit_index"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    return near.join(chunk_rows.select(id_, "chunk_index", "content"), [id_, "chunk_index"])


def search_documents(queries: DataFrame, chunk_rows: DataFrame, limit: int = 5, reach: int = 1, id_: str = "document_id", versions: DataFrame | None = None, scope: dict[str, str] | None = None) -> DataFrame:
    """The best passages of each query with their neighbours: qid, id_, hit_index, chunk_index, score, content. queries: qid, text and, for a vector
    lane, embedding; chunk_rows: id_, chunk_index, content and embedding.

    The BM25 lane and the vector lane are fused by ranks, over the best one's score. scope: columns of the passages and what they must be, before the lanes and
    so in all that follows. versions (id_, namespace_id, source_key, updated_at): passages of a version that is not its source's head are
    no results; they are left out before the results are cut, so a query gets its full number. Passages of no known version are none either."""
    limit = max(1, min(limit, 20))
    for column, value in (scope or {}).items():
        chunk_rows = chunk_rows.where(F.col(column) == value)
    vectors = "embedding" in queries.columns and "embedding" in chunk_rows.columns
    keyed = chunk_rows.withColumn("id", F.concat_ws("#", F.col(id_).cast("string"), F.lpad(F.col("chunk_index").cast("string"), 6, "0")))
    # made once: a task that makes passages does not hold their terms too
    keyed = kept(keyed.select("id", id_, "chunk_index", "content", *(["embedding"] if vectors else [])), "passages")
    most = min(8 * limit, 100)
    lanes = {"fts": retrieval.bm25_lane(queries, keyed, most)}
    if vectors:
        lanes["vector"] = retrieval.vector_lane(queries, keyed, most, exclude_self=False)
    fused = fusion.rrf(lanes).withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    found = fused.select("qid", "id", "score").join(keyed.select("id", id_, "chunk_index"), "id")
    if versions is not None:
        current = heads(versions.select("namespace_id", "source_key", "updated_at", F.col(id_).alias("document_id")))
        found = found.join(current.select(F.col("document_id").alias(id_)), id_, "left_semi")
    return with_neighbours(retrieval.top(found, limit), keyed, reach, id_)


def heuristic_entities(text: Column) -> Column:
    """Runs of title-case words, without small words at their ends, of 2 characters or more, at most 16 distinct."""
    # possessive repeats, as Java goes one call deeper with each repeat of a greedy group, and a run of some thousand words ends its stack
    runs = F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}\p{N}'-]*+(?:[ ]\p{Lu}[\p{L}\p{N}'-]*+)*+)"), 1)
    bare = F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, r"^(?:(?:The|A|An|I|It|He|She|We|They|This|That|In|On|At|And|But)(?: |$))++", ""), r"(?: (?:The|A|An|I|And|Of)(?= |$))++$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda r: F.length(r) >= 2)), 1, 16)


def profile_sections(text: Column) -> Column:
    """Array of (title, body): lines that start with # open a section; bullets belong to the section they are in."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=#)"), lambda p: F.length(F.trim(p)) > 0)
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), r"^\s*#+", "")).alias("title"), F.trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))


class Transcript:
    """The pieces of a text that comes line by line: a piece ends at its last line break if that is past its middle; the next one
    starts at a line break within the overlap, if there is one.

    Offsets count from the transcript's start. The breaks of the text that is held are a sorted list, in which both ends of a piece are looked up. Holds
    one piece and one line at most."""

    def __init__(self, max_chars: int, overlap: int) -> None:
        self.max_chars, self.overlap = max_chars, overlap
        self._empty()

    def _empty(self) -> None:
        self.text, self.origin, self.breaks = None, 0, []

    def _append(self, line: str) -> None:
        added = line if self.text is None else f"\n{line}"
        at = self.origin + len(self.text or "")
        self.breaks += [at + m.start() for m in LINE_END.finditer(added)]
        self.text = (self.text or "") + added

    def _ends(self) -> tuple[int, int]:
        """Where the first piece of the text ends, and where the next begins."""
        last = self.origin + self.max_chars
        near = self.breaks[: bisect_right(self.breaks, last)][-1:]
        end = next((b for b in near if b - self.origin > self.max_chars // 2), last)
        onward = max(self.origin + 1, end - self.overlap)
        inside = self.breaks[bisect_left(self.breaks, onward) : bisect_left(self.breaks, end)]
        return end, inside[0] + 1 if inside else onward

    def add(self, line: str) -> Iterator[str]:
        """The pieces that end before the end of ``line``."""
        self._append(line)
        while len(self.text) > self.max_chars:
            end, onward = self._ends()
            yield self.text[: end - self.origin]
            self.text, self.origin = self.text[onward - self.origin :], onward
            self.breaks = self.breaks[bisect_left(self.breaks, onward) :]

    def rest(self) -> Iterator[str]:
        if self.text:
            yield self.text
        self._empty()


def episode_chunks(messages: DataFrame, episode: str = "episode_id", order: str = "turn", max_chars: int = 16_000, overlap: int = 512) -> DataFrame:
    """(episode, index, count, content): transcripts of ``role: text`` lines in overlapping pieces. Where a piece ends depends on the
    one before it, so an episode is one task's, but its rows stream through in order and are never held together. Rows without
    an episode are one; a null role or text is an empty one."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = messages.select(F.col(episode).alias("episode"), F.col(order).alias("order"), line.alias("line"))
    rows = rows.repartition("episode").sortWithinPartitions("episode", "order", "line").select("episode", "line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, index, kind = None, False, 0, None
        text = Transcript(max_chars, overlap)
        for batch in batches:
            kind, out = batch.schema.field("episode").type, []
            for e, said in zip(batch.column("episode").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if seen and e != now:
                    out += [(now, index + k, piece) for k, piece in enumerate(text.rest())]
                    index = 0
                now, seen = e, True
                for piece in text.add(said):
                    out.append((e, index, piece))
                    index += 1
            yield _pieces(out, kind)
        if seen:
            yield _pieces([(now, index + k, piece) for k, piece in enumerate(text.rest())], kind)

    kind = messages.schema[episode].dataType.simpleString()
    pieces = kept(rows.mapInArrow(cut, f"episode {kind}, index int, content string"), "episode-chunks")
    counts = pieces.groupBy(F.col("episode").alias("of")).agg(F.count("*").cast("int").alias("count"))
    return pieces.join(counts, F.col("episode").eqNullSafe(F.col("of"))).select(F.col("episode").alias(episode), "index", "count", "content")


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    episode, index, content = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(episode, kind), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=["episode", "index", "content"])


# Words of no weight when a profile is searched.
PROFILE_STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "what", "who", "where", "when", "which", "does", "did", "was", "were", "are", "is", "has",
    "have", "had", "about", "tell", "me", "user", "person", "their", "his", "her", "she", "him", "they",
)


def profile_terms(text: Column) -> Column:
    """Distinct words without a plural s, of two characters or more."""
    bare = F.transform(words_of(text), lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(*PROFILE_STOP_WORDS)))


def search_sections(queries: DataFrame, sections: DataFrame, limit: int = 3, least: float = 0.01) -> DataFrame:
    """The sections of a query's own profile by the share of its terms that they hold, plus 0.25 for its exact wording.
    queries: qid, profile_id, text; sections: profile_id, id, title, body."""
    q = queries.select("qid", "profile_id", F.lower("text").alias("asked"), profile_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    s = sections.select("profile_id", "id", F.lower("body").alias("low"), profile_terms(F.concat_ws("\n", "title", "body")).alias("held"))
    exact = F.when(F.col("low").contains(F.col("asked")), 0.25).otherwise(0.0)
    scored = q.join(s, "profile_id").select("qid", "id", F.round(F.size(F.array_intersect("terms", "held")) / F.size("terms") + exact, 9).alias("score"))
    return retrieval.top(scored.where(F.col("score") >= least), limit)
