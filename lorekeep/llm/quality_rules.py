"""Quality rules: base counts of words, lines and repeats, and zstandard compression bands.

A text's compression ratio (UTF-8 bytes by zstandard bytes) is held against limits that depend on its length, as a
whole and in fixed chunks: repetitive text compresses too well, incompressible text (keys, base64) too badly. Chunks
catch a repetitive or random part inside a document whose whole ratio is in its band; every byte of a text of more than one
chunk is in one. Hexadecimal digits compress as prose does (1.87 to 1.93 at 2 KB), so no ratio tells them apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import steps, table
from .tokens import SLICE_BYTES, Coded, classes_of

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no character
LEVEL = 3
#: (bytes, lowest ratio, highest ratio) of texts and of chunks; between two lengths the limits lie on a line over log2(bytes).
#: Measured at 128, 256, 512, 1024 and 2048 bytes: base64 at most 0.98, 1.07, 1.19, 1.26 and 1.30; prose of four languages 1.00 to 1.56,
#: 1.22 to 1.75, 1.43 to 1.97, 1.67 to 2.23 and 1.91 to 2.41, and up to 2.9 at 64 KB; eight words in any order at least 1.42, 1.98, 2.68,
#: 3.89 and 4.65.
LIMITS = ((16, 0.3, 1.5), (128, 0.99, 1.8), (256, 1.14, 2.1), (512, 1.3, 2.4), (1024, 1.45, 2.9), (2048, 1.55, 3.2), (8192, 1.65, 3.6), (65536, 1.7, 4.2), (1 << 20, 1.7, 5.0))
#: Bytes of a chunk, at every length of a text: only the limits depend on length.
CHUNK = 512
#: A rest of fewer bytes is read with the chunk before it.
MIN_CHUNK = 256
#: The share of a text's chunks that may be outside their band. Chunks are counted, not their bytes, as a byte more in the last one would
#: tip a text of which a quarter is bad.
BAD_CHUNKS = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract; words are split at ASCII white space."""
    chars = len(text.translate(None, SPACES + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    if len(text) > SLICE_BYTES:
        n, repeats = _long_words(text)
        return n, chars, symbols, _long_lines(text), repeats
    found = text.split()
    lines = Counter(line for line in text.split(b"\n") if line.strip(SPACES))
    repeats = 0
    if len(found) > 3:  # two windows at least
        windows = Counter(zip(found, found[1:], found[2:], strict=False))
        if len(windows) < len(found) - 2:
            last = -1
            for i, w in enumerate(zip(found, found[1:], found[2:], strict=False)):
                if windows[w] > 1:
                    repeats += i + 2 - max(last, i - 1)
                    last = i + 2
    return len(found), chars, symbols, lines.total() - len(lines), repeats


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact code of each pair."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _long_words(text: bytes) -> tuple[int, int]:
    """n_words and n_repeat_words of a long text, from codes of its words: a few numbers for each word and no object."""
    code = Coded([text]).code
    if len(code) < 4:
        return len(code), 0
    window = _pairs(_pairs(code[:-2], code[1:-1]), code[2:])
    again = np.bincount(window)[window] > 1
    hit = np.zeros(len(code), bool)
    for j in range(3):
        hit[j : j + len(again)] |= again
    return len(code), int(hit.sum())


def _long_lines(text: bytes) -> int:
    """n_dup_lines of a long text, from codes of its lines."""
    lines = Coded([text], "line")
    seen = np.r_[0, np.cumsum(classes_of("space")[lines.data], dtype=np.int32)]
    codes = lines.code[seen[lines.end] > seen[lines.start]]
    return len(codes) - len(np.unique(codes))


@lru_cache(maxsize=65536)
def limits(size: int) -> tuple[float, float]:
    """The lowest and highest ratio of a text or chunk of so many bytes."""
    at = [math.log2(b) for b, _, _ in LIMITS]
    return float(np.interp(math.log2(size), at, [x for _, x, _ in LIMITS])), float(np.interp(math.log2(size), at, [x for _, _, x in LIMITS]))


def chunks_of(size: int) -> list[tuple[int, int]]:
    """Bounds of the chunks of a text; none if one chunk would hold it whole."""
    starts = list(range(0, size, CHUNK))
    if size - starts[-1] < MIN_CHUNK:
        starts.pop()
    return list(zip(starts, [*starts[1:], size], strict=True)) if len(starts) > 1 else []


def band_verdict(text: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, str | None]:
    """Ratio of the whole text, chunks, those out of their band, and the reason to reject (None: kept)."""
    if not text:
        return 1.0, 0, 0, None
    ratio = len(text) / len(squeeze.compress(text))
    low, high = limits(len(text))
    bounds = chunks_of(len(text))
    bad = 0
    for a, b in bounds:
        least, most = limits(b - a)
        bad += not least <= (b - a) / len(squeeze.compress(text[a:b])) <= most
    reason = "incompressible" if ratio < low else "repetitive" if ratio > high else "chunks" if bad > BAD_CHUNKS * len(bounds) else None
    return ratio, len(bounds), bad, reason


def rules(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts, base_failed, kept, ratio, n_chunks, n_bad_chunks and reason.

    kept is false for a text that fails the base rules or is outside its band. A null or empty text has no
    words, ratio 1 and fails the base rules. Repeated rows are judged each; an empty table gives an empty
    table. Other columns are not read, whatever their names. Words and lines are compared
    whole at every length. One pass over the rows, nothing is shuffled."""
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part, texts in steps(batch, "text"):
                counts = [base_counts(t) for t in texts]
                bands = [band_verdict(t, squeeze) for t in texts]
                failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c in counts]
                columns = [part.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(5)), pa.array(failed), pa.array([not f and b[3] is None for f, b in zip(failed, bands, strict=True)]), pa.array([b[0] for b in bands], pa.float64()), pa.array([b[1] for b in bands], pa.int64()), pa.array([b[2] for b in bands], pa.int64()), pa.array([b[3] for b in bands], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks", "reason"])

    return slim.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))
