"""Operators with exact contracts, against plain brute-force versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lorekeep.llm import chat, decontaminate, graph, mixing, paragraphs, quality_rules, queries, sharding, simhash, tokens
from lorekeep.llm.common import table

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
        (6, long, "de", "b", len(long)), (7, long + " tail", "de", None, 1), (None, "one", "en", "b", 3), (8, "Ünïcode ÄÖ 😀 text. " * 20, "de", "c", 1), (9, "a b c a b c a b c", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit("mine"), "shard": F.lit(7), "copies": F.lit("x"), "n_hit": F.lit("y"), "target": F.lit(1), "piece": F.lit(2)})


def brute_simhash(rows):
    out = []
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append((i, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))))
    distinct = sorted({f for _, f in out})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(distinct, np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= 2):
            parent[find(distinct[k + 1 + int(j)])] = find(f)
    least = {}
    for i, f in out:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, format(f, "016x"), least[find(f)]) for i, f in out), key=repr)


def test_simhash_whole_table(spark, sf_dir):
    got = sorted((tuple(r) for r in simhash.op4_simhash_bktree(spark, sf_dir).collect()), key=repr)
    assert got == brute_simhash([tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()])


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    got = simhash.near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_simhash([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_long_fingerprints(monkeypatch):
    """A long text has the same fingerprint, however small its slices."""
    rng = np.random.default_rng(4)
    texts = [b" ".join(b"W%d" % k for k in rng.integers(0, 999, n)) + b"\n" for n in (0, 1, 2, 3, 4, 5, 40, 5000)] + [b"x" * 3000, b" " * 3000, b"a " + b"y" * 2000 + b" b c d"]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE_BYTES", 7)
    assert [simhash.fingerprint(t) for t in texts] == whole


@pytest.mark.parametrize("kind", ["int", "string", "date"])
def test_near_duplicates_by_any_id(spark, kind):
    rows = [(1, "a b c d", 1), (1, "a b c d", 2), (1, "other words are here", 3), (2, "a b c d", 4), (None, "a b c d", 5), (None, "no one else says this", 6), (None, "no one else says this", 7), (5, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, component int")
    docs = docs.withColumn("doc_id", F.expr("date'2024-01-01' + doc_id") if kind == "date" else F.col("doc_id").cast(kind))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.text or "") for r in got.collect()) == ["", "a b c d", "no one else says this", "other words are here"]
    assert [r.component for r in got.collect() if r.text == "a b c d"][0] in (1, 2)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_bk_tree_slices(spark, monkeypatch):
    """A dense cluster over many slices and small frontiers has the links of all pairs."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 7))) for _ in range(600)})
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    root = np.arange(len(fps))
    at = {f: i for i, f in enumerate(fps)}
    pairs = np.array([(at[r.a], at[r.b]) for r in links])
    graph.local_roots(pairs[:, 0], pairs[:, 1], root)
    a = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2)
    assert np.array_equal(root, graph.local_roots(i, j, np.arange(len(fps))))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(31)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def windows_of(words, n=10):
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def brute_decontaminate(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(pattern, (t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = [(i, w) for i, t in items for w in windows_of(words(t))]
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        places = {}
        for n in {len(x) for _, x in windows}:
            for at in range(len(w) - n + 1):
                places.setdefault(tuple(w[at : at + n]), []).append(at)
        for item, x in windows:
            for at in places.get(x, ()):
                hit |= set(range(at, at + len(x)))
                found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


OURS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 2000])
def test_winnowing(spark, sf_dir, block_bytes):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    short = spark.createDataFrame([(900, "of the"), (901, None), (902, ""), (903, "the and of"), (900, "Of THE")], "item_id long, text string")
    items = items.unionByName(short)
    got = decontaminate.mark(docs, items, block_bytes).select("doc_id", "__leak.*").collect()
    want = brute_decontaminate([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in got), key=repr) == want


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 8])
def test_winnowing_edges(spark, block_bytes):
    docs = edge_docs(spark).withColumns({n: F.lit("mine") for n in ("n_words", "n_items", "items_sha256", "contaminated", "hit", "items", "part")})
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 515))), (2, "a b c a"), (3, "one"), (None, "Text")], "item_id long, text string")
    got = decontaminate.mark(docs, items, block_bytes, into="leak")
    assert got.columns == [*docs.columns, "leak"] and sorted(map(repr, got.drop("leak").collect())) == sorted(map(repr, docs.collect()))
    want = brute_decontaminate([(r.doc_id, r.text) for r in docs.collect()], [("null" if r.item_id is None else r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in got.select("doc_id", "leak.*").collect()), key=repr) == want
    assert decontaminate.mark(docs, items.limit(0)).where("__leak.contaminated").count() == 0
    assert decontaminate.mark(docs.limit(0), items, block_bytes).count() == 0


def test_long_texts_in_slices(monkeypatch):
    """A long text has the same hits, however small its slices."""
    rng = np.random.default_rng(2)
    told = [f"w{k}" for k in rng.integers(0, 3000, 40_000)]
    text = " ".join(told).encode()
    index = decontaminate.build_index(["a", "b", "c"], [" ".join(told[100:140]).encode(), b"w1 w2", " ".join(told[20_000:20_011]).encode()])
    whole = next(iter(decontaminate.batch_hits(index, [text[: decontaminate.SLICE_BYTES]])))
    monkeypatch.setattr(tokens, "SLICE_BYTES", 500)
    n, at, items = decontaminate.text_hits(index, text)
    assert (n, at.tolist(), items) == (whole[0], whole[1].tolist(), whole[2])
    for word in ("alnum", "space", "runs"):
        odd = b"  x" + text[:3000] + b"\n" + b"y" * 5000 + b", z..! "
        parts = [w.hash[held:] for w, held in tokens.slices(odd, word, lead=3)]
        assert np.array_equal(np.concatenate(parts), tokens.words([odd], word).hash)


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def brute_bands(text):
    """Why the bands reject a text, by the stated limits: straight lines over log2(bytes) between the measured lengths."""
    data, squeeze = (text or "").encode(), zstandard.ZstdCompressor(level=3)

    def outside(part):
        points, x = quality_rules.LIMITS, min(max(len(part), 16), 1 << 20)
        k = max(i for i, p in enumerate(points) if p[0] <= x)
        a, b = points[k], points[min(k + 1, len(points) - 1)]
        share = math.log2(x / a[0]) / math.log2(b[0] / a[0]) if a != b else 0.0
        ratio = len(part) / len(squeeze.compress(part))
        return "incompressible" if ratio < a[1] + share * (b[1] - a[1]) else "repetitive" if ratio > a[2] + share * (b[2] - a[2]) else None

    if not data:
        return None
    parts = [data[i : i + 512] for i in range(0, len(data), 512)]
    if len(parts) > 1 and len(parts[-1]) < 256:
        parts[-2:] = [parts[-2] + parts[-1]]
    bad = sum(outside(p) is not None for p in parts) if len(parts) > 1 else 0
    return outside(data) or ("chunks" if bad > 0.25 * len(parts) else None)


def test_quality_rules(spark, sf_dir):
    """All columns of whole tables against the brute-force version."""
    rng = np.random.default_rng(8)
    coded = [(k, base64.b64encode(rng.bytes(int(n))).decode().replace("+", " ").replace("/", " ").replace("a", " ")) for k, n in enumerate(rng.integers(300, 4000, 20))]
    few = [(50 + k, " ".join(rng.choice([f"w{j}" for j in range(int(m))], 400))) for k, m in enumerate((9, 12, 30, 60, 200))]
    for docs in (table(spark, sf_dir, "documents"), edge_docs(spark), spark.createDataFrame(coded + few, "doc_id long, text string")):
        got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.reason) for r in quality_rules.rules(docs).collect()]
        want = []
        for r in docs.collect():
            base, reason = brute_base(r.text), brute_bands(r.text)
            want.append((r.doc_id, *base, not base[-1] and reason is None, reason))
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    # rows that pass the base rules and fail the bands, and the reverse
    assert {r[8] for r in got if not r[6]} >= {"incompressible", "repetitive"} and any(r[6] for r in got)
    prose = [r for r in quality_rules.rules(table(spark, sf_dir, "documents")).collect() if not r.base_failed]
    assert np.mean([r.kept for r in prose]) > 0.99
    assert quality_rules.rules(docs.limit(0)).count() == 0


def test_long_text_counts(monkeypatch):
    """A long text's counts from hashes are those of its words and lines."""
    rng = np.random.default_rng(1)
    lines = [" ".join(f"ü{k}" for k in rng.integers(0, 40, n)) for n in rng.integers(0, 9, 3000)] + ["  ", "\t", ""] * 20
    text = "\n".join(lines).encode()
    want = quality_rules.base_counts(text[: quality_rules.SLICE_BYTES])
    monkeypatch.setattr(quality_rules, "SLICE_BYTES", 10)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 999)
    assert len(text) < 1 << 20 and quality_rules.base_counts(text) == want == (*brute_base(text.decode())[:5],)


PROSE = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "an", "er", "ing")]


@pytest.mark.parametrize("size", [300, 700, 1500, 2400, 4000, 8000, 20_000])
@pytest.mark.parametrize("last", [True, False])
def test_compression_bands(size, last):
    """Prose alone is kept; with a part of base64 of three fifths, at either end, or of few words over and over, it is rejected."""
    squeeze, rng = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL), np.random.default_rng(size)
    for _ in range(10):
        prose = " ".join("".join(rng.choice(PROSE, rng.integers(1, 4))) for _ in range(size // 4)).encode()[:size]
        coded = base64.b64encode(rng.bytes(size))[: int(size * 0.6)]
        rest = prose[: size - len(coded)]
        again = (b"again and again " * size)[: int(size * 0.6)]
        assert quality_rules.band_verdict(prose, squeeze)[3] is None
        assert quality_rules.band_verdict(coded, squeeze)[3] == "incompressible"
        assert quality_rules.band_verdict(again, squeeze)[3] == "repetitive"
        if size >= 700:
            assert quality_rules.band_verdict(rest + coded if last else coded + rest, squeeze)[3] is not None
            assert quality_rules.band_verdict(rest + again if last else again + rest, squeeze)[3] is not None


@pytest.mark.parametrize("size", [512, 768, 1024, 2048, 4096, 8192, 16_384, 32_768])
@pytest.mark.parametrize("share", [0.24, 0.26, 0.3])
def test_a_byte_more_flips_few_verdicts(size, share):
    """Prose with one run of base64, anywhere; no length is a switch. A text of up to two chunks is nearer to its limits."""
    squeeze, rng = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL), np.random.default_rng(size)
    prose = " ".join("".join(rng.choice(PROSE, rng.integers(1, 4))) for _ in range(size // 3)).encode()[:size]
    coded = base64.b64encode(rng.bytes(size))[: int(size * share)]
    flips = 0
    for at in rng.integers(0, size - len(coded), 200).tolist():
        text = prose[:at] + coded + prose[at + len(coded) :]
        flips += (quality_rules.band_verdict(text, squeeze)[3] is None) != (quality_rules.band_verdict(text + b"a", squeeze)[3] is None)
    assert flips <= (13 if size > 1024 else 20)


def test_chunks_cover_the_text():
    for size in (1, 255, 511, 512, 767, 768, 1024, 4096, 4097, 4400, 16384, 16385, 100_001):
        bounds = quality_rules.chunks_of(size)
        assert not bounds or (bounds[0][0], bounds[-1][1]) == (0, size) and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
        assert bounds or size < 768
        assert all(b - a >= 256 for a, b in bounds)


def test_mixing(spark, sf_dir):
    got = mixing.op6_pareto_mixing(spark, sf_dir).collect()
    again = mixing.op6_pareto_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    per, taken = Counter(), Counter()
    for i, r in docs.items():
        per[r.source] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(per), 1.5 * sum(per.values())
    while free:  # the excess is shared again until no target is above twice its source
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * per[s]}
        target |= {s: 2.0 * per[s] for s in over} or share
        left -= sum(2.0 * per[s] for s in over)
        free = free - over if over else set()
    longest = Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == per[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in per)


def test_mixing_probabilities(spark):
    """Over 400 sources of the same lengths each document is taken as often as its probability says, and unequally."""
    sizes = [3, 5, 8, 10, 14, 20, 24, 33, 47, 60, 90, 200]
    rows = [(k * 100 + i, f"s{k:04d}", "w " * n) for k in range(1200) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.allocate(docs, mixing.plan_for(docs)).select("doc_id", "source", "__mix.*").collect()
    seen = {}
    for r in got:
        if int(r.source[1:]) % 3 == 2:  # the third weight: a target of under its size
            seen.setdefault(r.size, []).append((r.p, r.copies))
    p = {n: x[0][0] for n, x in seen.items()}
    assert len({round(x, 6) for x in p.values()}) > 8 and p[3] < p[10] < p[33] < p[90] <= p[200]
    for n, x in seen.items():
        assert len(x) == 400 and all(abs(a - p[n]) < 1e-9 for a, _ in x)
        assert abs(np.mean([c for _, c in x]) - p[n]) < 0.1, (n, p[n], np.mean([c for _, c in x]))
    assert abs(sum(n * x for n, x in p.items()) - [r.target for r in got if r.source == "s0002"][0]) < 1e-6


def test_mixing_edges(spark):
    names = ["copies", "target", "source_size", "p", "rest", "whole", "v", "bin", "cut_bin", "size", "ties", "scale"]
    docs = edge_docs(spark).withColumns({n: F.concat(F.lit("mine "), F.col("doc_id").cast("string")) for n in names})
    out = mixing.allocate(docs, mixing.plan_for(docs), into="mix")
    assert out.columns == [*docs.columns, "mix"] and {r.mix.copies for r in out.collect()} <= {0, 1, 2}
    assert sorted(map(repr, out.drop("mix").collect())) == sorted(map(repr, docs.collect()))
    assert set(map(repr, mixing.mixed(docs).collect())) <= set(map(repr, docs.collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_equal_rows(spark):
    """Equal rows that straddle a source's cut are taken as far as they fit; so are null ids of one text."""
    rows = [(7, "a", "x " * 10)] * 90 + [(None, "b", "y " * 10)] * 300 + [(k, "c", "z " * (k % 9 + 1)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.allocate(docs, mixing.plan_for(docs)).select("source", "__mix.*").collect()
    assert len(got) == len(rows)
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 10


def brute_shards(rows, shards=8):
    """(doc_id, size, crc32, shard, slot) by the stated order, targets and rule for groups."""
    key = lambda t: int(hashlib.md5(t).hexdigest()[:15], 16)
    own = sorted(((key(t), i is not None, i or 0, i, len(t) + 1, zlib.crc32(t)) for i, t in rows), key=lambda r: r[:3])
    before = np.r_[0, np.cumsum([r[4] for r in own])]
    total, groups = int(before[-1]), {}
    for n, r in enumerate(own):
        lo, _ = groups.get(r[0], (before[n], 0))
        groups[r[0]] = (lo, before[n + 1])
    cuts = []
    for k in range(1, shards):
        t = k * total / shards
        near = [e for e in groups.values() if e[0] <= t < e[1] and (e[1] - e[0]) * shards * 16 <= total]
        cuts.append(min(near[0], key=lambda e: (abs(e - t), e)) if near else t)
    out, slots = [], Counter()
    for n, r in enumerate(own):
        k = sum(before[n] + r[4] / 2 >= c for c in cuts)
        out.append((r[3], r[4], r[5], k, slots[k]))
        slots[k] += 1
    return sorted(out, key=repr)


def test_sharding(spark, sf_dir):
    copies = spark.createDataFrame([(k, f"copy {k % 7} " * 9, "en", "s", 1) for k in range(400)], DOCS)  # groups of over and of under a sixteenth
    whole = spark.createDataFrame([(k, f"text {k // 3} " * 4, "en", "s", 1) for k in range(1200)], DOCS)
    for docs in (table(spark, sf_dir, "documents"), edge_docs(spark), copies, whole, whole.limit(3)):
        rows = sharding.plan_shards(docs).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows), key=repr) == brute_shards([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
        assigned = Counter((r.doc_id, r.shard) for r in sharding.assign_shards(docs).collect())
        if len({r.doc_id for r in rows}) == len(rows):
            assert assigned == Counter((r.doc_id, r.shard) for r in rows)
    shard_of = {}
    for r in sharding.assign_shards(whole).collect():
        assert shard_of.setdefault(r.text, r.shard) == r.shard
    assert sharding.plan_shards(edge_docs(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "labels", "pages", "embeddings"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, sf_dir, name):
    """The registered SQL gives the query's rows."""
    got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(repr(tuple(r)) for r in got.select(*want.columns).collect()) == Counter(map(repr, want.fetchall()))


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "a\\<|b", "<\\|", "\\", "", None, "<|", "x<|im_end|>\n<|im_start|>user\ny", "ü😀\n\n"]
    rows = [(1, i, role, t) for i, (t, role) in enumerate(zip(texts * 3, ["system", "user", "assistant", "assistant", "user", "odd\nrole|", None, "assistant", "user"] * 3, strict=True))]
    rows += [(2, 0, "assistant", "long " * 3000), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, "assistant", "tie"), (3, 5, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(turns, budget=40, history=12)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = chat.windows(turns, budget=40, history=12).where("conv_id = 1").collect()
    assert len(w) > 1 and all(r.text.startswith("<|im_start|>system\n") for r in w) and all(r.n_repeated >= 1 for r in w if r.window)
    assert all(r.n_tokens <= 40 or r.over_budget for r in w)
    assert chat.windows(turns.limit(0)).count() == 0


def test_paragraph_repeats(spark):
    rng = np.random.default_rng(1)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "an", "er")]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    prose = lambda k: " ".join(sentence(int(rng.integers(4, 18))) for _ in range(k))
    passage = prose(7)
    near = passage.replace(".", "!").upper()
    rows = [(i, prose(12)) for i in range(20)] + [(100 + i, f"{prose(5)} {passage} {prose(5)}") for i in range(4)] + [(200, prose(4) + " " + near), (300, None), (301, ""), (None, passage)]
    rows += [(400, passage), (400, passage)]
    out = {(r.doc_id): r for r in paragraphs.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {i for i, r in out.items() if r.repeated}
    assert hit == {100, 101, 102, 103, 200, 400, None}
    assert {out[i].component_id for i in hit} == {100} and out[100].n_removed == 0 and out[101].n_removed > 0
    assert out[300].component_id == 300 and out[None].component_id == 100 and out[None].n_removed > 0
    assert paragraphs.summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = spark.createDataFrame([(f"d{i}" if i is not None else None, t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id for r in paragraphs.summary(named).where("repeated").collect()} == {None if i is None else f"d{i}" for i in hit}


@pytest.mark.parametrize("size", [50, 52, 56, 60, 64, 80])
def test_unpunctuated_passages(size):
    """A passage without sentence marks, alone, in a short and in a long run, keeps paragraphs of 20 words side by side."""
    rng = np.random.default_rng(size)
    run = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 100_000, n))
    found = 0
    for _ in range(200):
        told = run(size)
        hashes = [set(paragraphs.Paragraphs([t.encode()]).hash.tolist()) for t in (told, f"{run(20)} {told}, {run(9)}", f"{run(140)} {told} {run(150)}")]
        p = paragraphs.Paragraphs([f"{run(140)} {told} {run(150)}".encode()])
        same = [(a, a + b) for a, b, h in zip(p.start.tolist(), p.size.tolist(), p.hash.tolist(), strict=True) if all(h in x for x in hashes)]
        found += bool(same) and same[-1][1] - same[0][0] >= paragraphs.MIN_PASSAGE
    assert found >= 180, found


def test_long_paragraphs(monkeypatch):
    """A long text has the same paragraphs, however small its slices."""
    rng = np.random.default_rng(9)
    text = "".join(f"w{k}" + rng.choice([" ", " ", " ", " ", " ", ", ", ". ", "\n"]) for k in rng.integers(0, 9999, 9000))
    text += " ".join(f"v{k}" for k in rng.integers(0, 9999, 3000)) + ". one two. three four five six seven eight"
    data = text.encode()
    whole = paragraphs.Paragraphs([data])
    want = list(zip(whole.start.tolist(), whole.size.tolist(), whole.hash.tolist(), whole.first_byte.tolist(), strict=True))
    for size in (300, 1000, 7000):
        monkeypatch.setattr(paragraphs, "SLICE_BYTES", size)
        got = [(s + w, n, h, f + b) for p, w, b in paragraphs.read([data]) for s, n, h, f in zip(p.start.tolist(), p.size.tolist(), p.hash.tolist(), p.first_byte.tolist(), strict=True)]
        assert got == want


def test_repeats_of_a_whole_table(spark):
    """All 1,000 documents against all windows of words: shared passages of 51 words are found, documents that share none of 6 are left."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    told = {r.doc_id: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().translate(LOWER)) for r in docs.collect()}

    def holders(n):
        seen = {}
        for i, w in told.items():
            for k in range(len(w) - n + 1):
                seen.setdefault(hash(tuple(w[k : k + n])), set()).add(i)
        return [x for x in seen.values() if len(x) > 1]

    out = {r.doc_id: r for r in paragraphs.summary(docs).collect()}
    long = holders(51)
    pairs = {(min(x), i) for x in long for i in x if i != min(x)}
    assert len(pairs) > 50 and np.mean([out[a].repeated and out[b].repeated and out[a].component_id == out[b].component_id for a, b in pairs]) >= 0.98
    short = set().union(*holders(6))
    assert not [i for i, r in out.items() if r.repeated and i not in short]


def test_paragraph_links():
    """Verified links of a group have the components of all pairs at the similarity."""
    rng = np.random.default_rng(5)
    base = rng.choice(10_000, 30, replace=False)
    lists = [np.unique(np.r_[rng.choice(base, rng.integers(20, 31), replace=False), rng.integers(20_000, 30_000, rng.integers(0, 4))]).astype(np.int64) for _ in range(60)]
    a, b = paragraphs._verify(np.arange(60), lists, np.zeros(60, int), 0.8)
    near = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(lists[i], lists[j])) >= 0.8 * len(np.union1d(lists[i], lists[j]))]
    want = graph.local_roots(np.array([i for i, _ in near]), np.array([j for _, j in near]), np.arange(60))
    got = np.arange(60)
    for _ in range(60):
        for x, y in zip(a, b, strict=True):
            got[x] = got[y] = min(got[x], got[y])
    assert [[got[i] == got[j] for j in range(60)] for i in range(60)] == [[want[i] == want[j] for j in range(60)] for i in range(60)]


def test_band_tuning():
    assert 1 - (1 - 0.8**paragraphs.STRICT_ROWS) ** paragraphs.STRICT_BANDS >= paragraphs.RECALL
    assert paragraphs.tune_bands(1) == 3
