"""Scalar expressions of the engine's semantics as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "what", "who", "where", "when", "which", "does", "did", "was", "were", "are", "is", "has",
    "have", "had", "about", "after", "before", "during", "into", "from", "her", "his", "their", "she", "him", "they", "didn", "doesn", "kind", "type",
)

# The importance of a memory by type, and the weight factor of an edge by relation.
DEFAULT_IMPORTANCE = {"identity": 1.0, "goal": 0.9, "decision": 0.8, "todo": 0.8, "preference": 0.7, "fact": 0.6, "event": 0.4, "observation": 0.3}
RELATION_FACTOR = {"updates": 1.5, "caused_by": 1.3, "result_of": 1.3, "related_to": 1.0, "part_of": 0.8, "contradicts": 0.5, "same_slot": 1.25, "same_entity": 0.85, "same_episode": 0.65}


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed table (null if the key is not in it)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def trim_space(x: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def key_of(x: Column) -> Column:
    return F.lower(trim_space(x))


def value_key(x: Column) -> Column:
    """Trimmed, lower-cased, with runs of white space as one space."""
    return F.regexp_replace(key_of(x), r"(?U)\s+", " ")


def index_terms(x: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and Han characters of at least two characters, repeats included."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9一-鿿]+"), lambda t: F.length(t) > 1)


def words_of(x: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def content_terms(x: Column) -> Column:
    return F.array_distinct(F.filter(words_of(x, 3), lambda t: ~t.isin(*STOP_WORDS)))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


def token_estimate(x: Column) -> Column:
    return F.ceil(utf16_length(x) / 4)


def credit_units(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(x) / 8192)).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has length 0; the shorter one's dimensions count."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as eight hex digits."""
    raw = F.hex(F.encode(x, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.greatest((F.length(raw) / 4).cast("int") - 1, F.lit(0))), lambda i: F.conv(F.substr(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    hashed = F.aggregate(F.when(F.length(raw) > 0, units).otherwise(F.array().cast("array<bigint>")), F.lit(2166136261), lambda h, u: h.bitwiseXOR(u) * F.lit(16777619) % F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(hashed), 8, "0"))


def stable_uuid(x: Column) -> Column:
    """A UUID from the SHA-256 of the text, with the bits of version 5 and of the variant set."""
    h = F.sha2(x, 256)
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("long") % 4 + 8))
    return F.concat(F.substr(h, F.lit(1), F.lit(8)), F.lit("-"), F.substr(h, F.lit(9), F.lit(4)), F.lit("-5"), F.substr(h, F.lit(14), F.lit(3)), F.lit("-"), variant, F.substr(h, F.lit(18), F.lit(3)), F.lit("-"), F.substr(h, F.lit(21), F.lit(12)))


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of token precision and recall; 1 if both are empty, 0 if one is."""
    p, g = words_of(prediction), words_of(gold)
    same = token_overlap(p, g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def bleu1(prediction: Column, gold: Column) -> Column:
    """Clipped unigram precision times the brevity penalty; 0 if either is empty."""
    p, g = words_of(prediction), words_of(gold)
    brevity = F.when(F.size(p) >= F.size(g), F.lit(1.0)).otherwise(F.exp(1 - F.size(g) / F.size(p)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(brevity * token_overlap(p, g) / F.size(p))
