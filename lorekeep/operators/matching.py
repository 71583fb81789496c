"""Facts that meet requirements: text fragments found by an index of terms, and the most requirements that can be met at once.

A fragment of letters, digits, underscores and hyphens must stand alone in a fact's text; any other must be a part of it. Each fragment is looked up
under one key that every text that holds it has: a whole word of it, or three characters in a row where none of its words is sure to be whole. So facts
meet only the fragments whose key they have, and are then compared in full."""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .graph import components

WORD = r"[\p{L}\p{N}_]"
LONE = rf"^(?:{WORD}|-)+$"


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in NFKC, lower case, runs of white space as one space, trimmed; null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {c: pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in batch.column(batch.schema.get_field_index(c)).to_pylist()], pa.string()) for c in columns}
            yield pa.RecordBatch.from_arrays([made.get(n, a) for n, a in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    clean = lambda c: F.coalesce(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), F.lit(""))
    return df.mapInArrow(run, df.schema).withColumns({c: clean(c) for c in columns})


def _key(needle: Column) -> Column:
    """The key of a fragment: a word, or a space and three characters; empty for one of neither, under which every fact is."""
    words = F.regexp_extract_all(needle, F.lit(f"({WORD}+)"), 1)
    longest = lambda w: F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))  # the first and last may be parts of longer words
    some = F.concat(F.lit(" "), F.substring(needle, 1, 3))
    return F.when(needle.rlike(LONE), F.coalesce(longest(words), F.lit(""))).when(F.size(inner) > 0, longest(inner)).when(F.length(needle) >= 3, some).otherwise("")


def _holds(text: Column, needle: Column) -> Column:
    """Whether a text holds a fragment; its characters are quoted as they are."""
    pattern = F.concat(F.lit(rf"(?:^|(?!{WORD})[\s\S])\Q"), needle, F.lit(rf"\E(?:$|(?!{WORD})[\s\S])"))
    return F.when(needle.rlike(LONE), F.regexp_like(text, pattern)).otherwise(text.contains(needle))


def met_by(matchers: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, requirement, fact): facts that meet a requirement of their case. matchers: case_id, requirement, all_text and any_text (arrays of fragments),
    subject, attribute, memory_types (array); facts: case_id, fact, text, subject, attribute, memory_type.

    All of all_text, and one of any_text if there are any, must be in the text; an empty fragment is in none. subject and attribute must be
    equal where they are given, and the type one of memory_types. A requirement without fragments is held against the facts of its case by
    subject or attribute, or against all of them if it has neither. Null case ids meet nothing."""
    facts = kept(flat(facts, "text", "subject", "attribute"), "facts").withColumnRenamed("case_id", "__case")
    wants = kept(flat(matchers.withColumns({"__subject": F.col("subject").isNotNull(), "__attribute": F.col("attribute").isNotNull()}), "subject", "attribute"), "matchers")
    parts = wants.select("case_id", "requirement", F.explode(F.concat(F.transform(F.coalesce("all_text", F.array()), lambda t: F.struct(t.alias("text"), F.lit(True).alias("all"))), F.transform(F.coalesce("any_text", F.array()), lambda t: F.struct(t.alias("text"), F.lit(False).alias("all"))))).alias("p"))
    parts = flat(parts.select("case_id", "requirement", "p.text", "p.all"), "text").withColumnRenamed("text", "needle").distinct()
    parts = kept(parts.withColumn("key", _key(F.col("needle"))), "fragments")
    words = F.regexp_extract_all("text", F.lit(f"({WORD}+)"), 1)
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1))), lambda i: F.concat(F.lit(" "), F.substr("text", i, F.lit(3))))
    # three characters are listed for the cases that look for any
    short = parts.where("key like ' %'").select(F.col("case_id").alias("__case")).distinct().withColumn("__short", F.lit(True))
    keyed = facts.join(short, "__case", "left").select("__case", "fact", "text", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words, F.when(F.col("__short"), threes).otherwise(F.array().cast("array<string>"))))).alias("__key"))
    hits = parts.where("needle <> ''").join(keyed, (F.col("case_id") == F.col("__case")) & (F.col("key") == F.col("__key"))).where(_holds(F.col("text"), F.col("needle")))
    found = hits.groupBy("case_id", "requirement", "fact").agg(F.count_if("all").alias("alls"), F.count_if(~F.col("all")).alias("anys"))
    asked = parts.groupBy("case_id", "requirement").agg(F.count_if("all").alias("all_of"), F.count_if(~F.col("all")).alias("any_of"))
    texts = found.join(asked, ["case_id", "requirement"]).where("alls = all_of and (any_of = 0 or anys > 0)").select("case_id", "requirement", "fact")
    f = facts.select("__case", F.col("fact").alias("__fact"), F.col("subject").alias("__s"), F.col("attribute").alias("__a"), "memory_type")
    same = F.col("case_id") == F.col("__case")
    bare = wants.join(asked, ["case_id", "requirement"], "left_anti")
    told = [
        texts.join(wants, ["case_id", "requirement"]).join(f, same & (F.col("fact") == F.col("__fact"))).drop("fact"),
        bare.where("__subject").join(f, same & (F.col("subject") == F.col("__s"))),
        bare.where("not __subject and __attribute").join(f, same & (F.col("attribute") == F.col("__a"))),
        bare.where("not __subject and not __attribute").join(f, same),
    ]
    names = ("case_id", "requirement", "__fact", "subject", "__subject", "attribute", "__attribute", "memory_types", "__s", "__a", "memory_type")
    every = reduce(DataFrame.unionByName, [t.select(*names) for t in told])
    fits = (~F.col("__subject") | (F.col("subject") == F.col("__s"))) & (~F.col("__attribute") | (F.col("attribute") == F.col("__a")))
    kind = (F.coalesce(F.size("memory_types"), F.lit(0)) <= 0) | F.coalesce(F.array_contains("memory_types", F.col("memory_type")), F.lit(False))
    return every.where(fits & kind).select("case_id", "requirement", F.col("__fact").alias("fact")).distinct()


def most_matches(links: list[tuple]) -> int:
    """The size of a largest set of links (requirement, fact) of which no two share an end, by shortest augmenting paths (Hopcroft and Karp)."""
    wants: dict = {}
    for r, f in links:
        wants.setdefault(r, []).append(f)
    of, by = dict.fromkeys(wants), {}  # a requirement's fact, a fact's requirement
    while True:
        level, queue, free = {r: 0 for r in wants if of[r] is None}, deque(r for r in wants if of[r] is None), False
        while queue:
            r = queue.popleft()
            for f in wants[r]:
                if f not in by:
                    free = True
                elif by[f] not in level:
                    level[by[f]] = level[r] + 1
                    queue.append(by[f])
        if not free:
            return sum(f is not None for f in of.values())
        rest = {r: iter(fs) for r, fs in wants.items()}
        for start in [r for r in wants if of[r] is None]:
            path = [start]  # depth first along the levels
            while path:
                r = path[-1]
                for f in rest[r]:
                    if f not in by:
                        for at in reversed(path):  # each takes the fact that its successor had
                            of[at], by[f], f = f, at, of[at]
                        path = []
                        break
                    if level.get(by[f], -1) == level[r] + 1:
                        path.append(by[f])
                        break
                else:
                    level[r] = -1
                    path.pop()


def matched(links: DataFrame) -> DataFrame:
    """Most requirements of each case that can be met if a fact meets one at most: case_id, met, linked (requirements with a fact). links: case_id,
    requirement, fact. Requirements and facts that no chain of links joins don't compete: each connected part is matched by itself, so a case
    spans as many tasks as it has parts, and a task holds one part's links."""
    # nodes are their place in an order of plain longs
    ends = links.select("case_id", F.lit("r").alias("side"), F.col("requirement").cast("string").alias("of")).union(links.select("case_id", F.lit("f"), F.col("fact").cast("string"))).distinct()
    nodes = kept(ends.withColumn("node", F.monotonically_increasing_id()), "match-nodes")
    r, f = (nodes.where(F.col("side") == s).select(F.col("case_id").alias("__case"), F.col("of").alias(f"__{s}"), F.col("node").alias(n)) for s, n in (("r", "a"), ("f", "b")))
    on = lambda side, column: F.col("case_id").eqNullSafe(F.col("__case")) & (F.col(column).cast("string") == F.col(f"__{side}"))
    joined = links.distinct().join(r, on("r", "requirement")).drop("__case", "__r").join(f, on("f", "fact")).drop("__case", "__f")
    joined = kept(joined.select("case_id", "a", "b"), "match-links")
    parts = components(joined.select("a", "b"))
    kind = links.schema["case_id"].dataType.simpleString()

    def match(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"case_id": part["case_id"].iloc[:1], "met": [most_matches(list(zip(part["a"], part["b"], strict=True)))], "linked": [part["a"].nunique()]})

    each = joined.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").applyInPandas(match, f"case_id {kind}, met long, linked long")
    return each.groupBy("case_id").agg(F.sum("met").alias("met"), F.sum("linked").alias("linked"))
