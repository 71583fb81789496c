"""Vectorised words and hashes over many texts at once (numpy, inside tasks).

Texts are laid end to end in one byte array; a word is a maximal run of bytes whose class is not 0.
Its hash is a polynomial over its bytes from running sums, so that a step costs a few array passes
however many words it holds; the sums are taken in blocks and kept at the ends of words alone, so a byte costs a few
bytes of memory. A long text is read in slices that end between words (see ``slices``). Hashes pick candidates; whoever
needs certainty compares the bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64, size: int) -> np.ndarray:
    """1, base, base**2, ... They are not kept: a worker that waits for its next task should hold little."""
    out = np.full(size, base)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def classes_of(word: str) -> np.ndarray:
    """The class of each byte: 0 separates words. ``space``: all but ASCII white space is one class.
    ``line``: all but the line feed.
    ``alnum``: ASCII letters, digits and all non-ASCII. ``runs``: as alnum, other visible bytes are class 2."""
    byte = np.arange(256)
    if word == "space":
        return (~np.isin(byte, [32, 9, 10, 11, 12, 13])).astype(np.uint8)
    if word == "line":
        return (byte != 10).astype(np.uint8)
    letters = (byte >= 0x80) | ((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x61) & (byte <= 0x7A)) | ((byte >= 0x41) & (byte <= 0x5A))
    if word == "alnum":
        return letters.astype(np.uint8)
    return np.where(letters, 1, np.where(byte > 32, 2, 0)).astype(np.uint8)


#: Bytes whose running sums are held at once; bytes of one slice of a long text.
BLOCK_BYTES = 1 << 18
SLICE_BYTES = 1 << 20
_GAP = {w: re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in np.flatnonzero(classes_of(w) == 0).tolist()) + b"]") for w in ("space", "line", "alnum", "runs")}
WORD_GAP = _GAP["alnum"]

LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts, each followed by a line feed
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # the text that the word is of
    hash: np.ndarray
    count: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word
    stop: np.ndarray  # offset in data after each text and its line feed

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (b excluded), joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word: the sum of its bytes' values times growing powers, brought back to power 0 at its start."""
    up, down = _powers(_BASE, BLOCK_BYTES + 1), _powers(_INVERSE, BLOCK_BYTES + 1)
    at_start, at_end, back = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    carried, power, inverse = np.uint64(0), np.uint64(1), np.uint64(1)
    values = _byte_values()
    i = j = 0
    for at in range(0, len(data), BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = carried
        np.cumsum(up[: len(part)] * values[part] * power, out=total[1:])
        total[1:] += carried
        stop = at + len(part)
        i2, j2 = np.searchsorted(start, stop), np.searchsorted(end, stop, side="right")
        at_start[i:i2] = total[start[i:i2] - at]
        back[i:i2] = down[start[i:i2] - at] * inverse
        at_end[j:j2] = total[end[j:j2] - at]
        i, j, carried = i2, j2, total[-1]
        power, inverse = power * up[len(part)], inverse * down[len(part)]
    return mix((at_end - at_start) * back)


def words(texts: list[bytes], word: str = "alnum", lower: bool = True) -> Words:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    data = LOWER[data] if lower else data
    kind = classes_of(word)[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    kinds = np.append(kind, np.uint8(0))[edge]
    start = edge[kinds > 0]
    end = edge[np.flatnonzero(kinds > 0) + 1]
    with np.errstate(over="ignore"):
        hashed = _word_hashes(data, start, end)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    stops = np.cumsum(sizes)
    doc = np.searchsorted(stops, start, side="right")
    count = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    return Words(data, start, end, doc, hashed, count, np.cumsum(count) - count, stops)


def slices(text: bytes, word: str = "alnum", lower: bool = True, lead: int = 0, size: int | None = None) -> Iterator[tuple[Words, int]]:
    """The words of a long text, a slice of about ``size`` bytes at a time: (words, how many of the first belong to the
    slice before). A slice ends between words, however far the next gap is, and holds the last ``lead`` words of those before it."""
    size = SLICE_BYTES if size is None else size
    at, tail = 0, b""
    while at < len(text):
        gap = _GAP[word].search(text, at + size) if at + size < len(text) else None
        end = gap.end() if gap else len(text)
        w = words([tail + text[at:end]], word, lower)
        held = len(words([tail], word, lower).hash) if tail else 0
        yield w, held
        if lead:
            first = w.start[max(0, len(w.start) - lead)] if len(w.start) else len(tail) + end - at
            tail = (tail + text[at:end])[first:]
        at = end


class Coded:
    """The words of some texts, by their places in the texts' bytes, with an exact code for each: words are equal if their codes are."""

    def __init__(self, texts: list[bytes], word: str = "space"):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        seen = classes_of(word)[self.data]
        edge = np.flatnonzero(np.diff(seen, prepend=np.uint8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        held = self.data[seen.astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        wide = offsets[-1] >= 1 << 31
        array = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(self.start), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(held)])
        self.code = array.dictionary_encode().indices.to_numpy()
        stops = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.start, stops)])  # of each text's words, and the end of the last


def gram_hash(hashes: np.ndarray, at: np.ndarray | None, k: int) -> np.ndarray:
    """Hash of the k words from each position in ``at`` on (None: from every position that has k)."""
    out = np.zeros(max(0, len(hashes) - k + 1) if at is None else len(at), np.uint64)
    for j in range(k):
        odd = np.uint64((2 * k + 1) * pow(int(_BASE), j + 1, 1 << 64) & (1 << 64) - 1)
        out += (hashes[j : len(hashes) - k + 1 + j] if at is None else hashes[at + j]) * odd
    return mix(out)


def byte_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all runs of n bytes of a text and its line feed, the bytes as in ``w``."""
    if len(w.data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.zeros(len(w.data) - n + 1, np.uint64)
    for j in range(n):  # n is at most 8: the bytes themselves, then mixed
        at = (at << np.uint64(8)) | w.data[j : len(w.data) - n + 1 + j]
    doc = np.repeat(np.arange(len(w.stop)), np.diff(w.stop, prepend=0))
    inside = doc[: len(at)] == doc[n - 1 :]
    return doc[: len(at)][inside], mix(at[inside])
