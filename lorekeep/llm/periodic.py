"""Periodic runs of words, found by probing harmonic grids.

A run of period p has length 4 p or more, so the stretch in which a word equals the one p further on spans three points of the
grid 0, p, 2p, ... For each p only those points are probed, at jp and (j + 1)p: n / p tests, n log n over all periods.
Points with two further hits behind them survive; a few words between them are tested as well, then a survivor is
extended to both sides by comparing chunks of arrays. Grid points in a stretch that is known are skipped: in one of the same period, or
in a run whose period divides p (a longer stretch of period p around it would be that run).

Words are compared by exact codes of a dictionary, not by hashes. Short documents of like lengths are laid end to end, with a code of
its own between two of them, and probed together.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table
from .tokens import Coded

#: A run is at least so many words long, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words in which a survivor's first and largest comparison is made.
CHUNK, MAX_CHUNK = 16, 1 << 16
#: Bytes of output that are gathered at once.
PIECE_BYTES = 1 << 20
#: Words of another document that are laid out together; longer documents are probed alone.
GROUP_WORDS = 1 << 16
#: What the places of words are taken from: (doc_id, words) to the index of the word at each place, or None for the text's own order.
Order = Callable[[object, int], np.ndarray | None]


class _Words(Coded):
    def joined(self, words: np.ndarray) -> bytes:
        """The words at these places in this order, joined by one space."""
        out, size = [], self.end[words] - self.start[words] + 1
        total = np.cumsum(size)
        cuts = np.unique([0, *np.searchsorted(total, np.arange(PIECE_BYTES, size.sum(), PIECE_BYTES)), len(words)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a + 1:
                out.append(self.data[self.start[words[a]] : self.end[words[a]]].tobytes() + b" ")
                continue
            n, until = size[a:b], np.cumsum(size[a:b])
            piece = self.data[np.repeat(self.start[words[a:b]] - until + n, n) + np.arange(until[-1])]
            piece[until - 1] = 0x20
            out.append(piece.tobytes())
        return b"".join(out)[:-1]


def _reach(codes: np.ndarray, at: int, p: int, stop: int) -> int:
    """The first place in [at, stop) whose word differs from the one p further on (stop if none does)."""
    size = CHUNK
    while at < stop:
        size = min(size, stop - at)
        equal = codes[at : at + size] == codes[at + p : at + p + size]
        if not equal.all():
            return at + int(np.argmin(equal))
        at, size = at + size, min(4 * size, MAX_CHUNK)
    return stop


def _reach_back(codes: np.ndarray, at: int, p: int) -> int:
    """The first place of the stretch of words up to ``at`` that equal the one p further on."""
    size = CHUNK
    while at > 0:
        size = min(size, at)
        equal = codes[at - size : at] == codes[at - size + p : at + p]
        if not equal.all():
            return at - int(np.argmin(equal[::-1]))
        at, size = at - size, min(4 * size, MAX_CHUNK)
    return 0


def runs(codes: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of ``codes``, by start and period.

    longest: the length of the longest document in ``codes``, if several are laid end to end with a code of its own between them."""
    n, found = len(codes), []
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p in range(1, (n if longest is None else longest) // LEAST_TIMES + 1):
        grid = codes[::p]
        hit = grid[:-1] == grid[1:]
        at = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:]) * p if len(hit) > 2 else np.zeros(0, int)
        for k in (1, 2, 3, 5, 7, 11):  # words between three grid points of a run are equal too
            if not len(at):
                break
            between = at + k * p // 6
            at = at[codes[between] == codes[between + p]]
        if not len(at):
            continue
        for q, (starts, ends) in by_period.items():
            if p % q == 0:  # both points in such a run: nothing new
                k = np.searchsorted(starts, at, side="right") - 1
                at = at[(k < 0) | (at + p >= ends[k])]
        known, mine = 0, []
        for x in at.tolist():
            if x < known:
                continue
            known = _reach(codes, x, p, n - p)
            a = _reach_back(codes, x, p)
            length = known - a + p
            if length >= max(LEAST_WORDS, LEAST_TIMES * p):
                mine.append((a, length, p))
        if mine:
            found += mine
            by_period[p] = (np.array([a for a, _, _ in mine]), np.array([a + m for a, m, _ in mine]))
    return sorted((a, m, p) for a, m, p in found)


def _runs_of_all(parts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``runs`` of each part. Parts whose lengths are within a factor of two are probed together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    held: dict[int, int] = defaultdict(int)
    for i, part in enumerate(parts):
        if len(part) >= LEAST_WORDS:
            size = len(part).bit_length()
            groups[size, held[size] // GROUP_WORDS].append(i)
            held[size] += len(part)
    for members in groups.values():
        most = max(int(parts[i].max()) for i in members)
        laid = np.concatenate([x for k, i in enumerate(members) for x in (parts[i], np.array([most + 1 + k]))])
        starts = np.concatenate([[0], np.cumsum([len(parts[i]) + 1 for i in members])])
        found = runs(laid, max(len(parts[i]) for i in members))
        for (a, m, p), k in zip(found, np.searchsorted(starts, [a for a, _, _ in found], side="right") - 1, strict=True):
            out[members[k]].append((a - int(starts[k]), m, p))
    return out


def _kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The places of words that no run drops: a run keeps its first period."""
    step = np.zeros(n + 1, np.int64)
    for a, m, p in found:
        step[a + p] += 1
        step[a + m] -= 1
    return np.flatnonzero(np.cumsum(step[:-1]) == 0)


def _strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties: the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), strongest (null without a run) and collapsed (the kept words joined by one
    space) for every row of ``docs`` (doc_id, text).

    A run is a stretch of words with smallest period p, at least LEAST_WORDS and LEAST_TIMES * p long, that no neighbouring word extends; runs
    may overlap. Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows are judged each, a null
    doc_id is a row as any other, an empty table gives an empty table, other columns are not read. order: takes a text's words in another order
    first. One pass over the rows, nothing is shuffled; a task holds about a megabyte of texts, or one longer text with about
    40 bytes for each of its words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part, texts in steps(batch, "text"):
                words = _Words(texts)
                places = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.arange(words.first[i], words.first[i + 1])
                    new = order(doc, len(own)) if order and len(own) else None
                    places.append(own if new is None else own[new])
                found = _runs_of_all([words.code[x] for x in places])
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
                best = [None if (r := _strongest(f)) is None else dict(zip(("start", "length", "period"), r, strict=True)) for f in found]
                collapsed = [words.joined(x[_kept_words(len(x), f)]).decode() for x, f in zip(places, found, strict=True)]
                columns = [part.column("doc_id"), pa.array([len(x) for x in places], pa.int64()), pa.array(rows, pa.list_(pair)), pa.array(best, pair), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string")


def planted_order(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's order of a document's words: in one document of ten, those from a place on repeat with a period. The place and the
    period come from the crc32 of the id; a null id has the text's own order."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op12_harmonic_grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, after the contract's order of words, as counts and digests."""
    found = periodic_runs(table(spark, sf_dir, "documents"), planted_order)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
