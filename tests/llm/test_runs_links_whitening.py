"""Periodic runs, redirect equivalence and whitening, against plain brute-force versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import periodic, queries, url_rules, whitening
from lorekeep.llm.common import table


def brute_runs(codes):
    out = []
    for q in range(1, len(codes) // 4 + 1):
        i = 0
        while i < len(codes) - q:
            j = i
            while j < len(codes) - q and codes[j] == codes[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = codes[i : i + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_op12(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    dropped = {i for a, m, p in found for i in range(a + p, a + m)}
    lines = "".join(f"{a},{m},{p}\n" for a, m, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6])
        codes = [rng.randrange(k) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            codes = [codes[a + (i - a) % p] if i >= a else codes[i] for i in range(n)]
        assert periodic.runs(np.array(codes, np.int64)) == brute_runs(codes)


def test_runs_of_nested_powers_and_fibonacci_words():
    deep = [0, 1] * 4 + [2]
    assert periodic.runs(np.array(deep * 5)) == brute_runs(deep * 5)
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert periodic.runs(np.array(b * 4)) == brute_runs(b * 4)


def test_documents_probed_together_equal_documents_alone():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 2, int(rng.integers(0, 400))) for _ in range(200)]
    assert periodic._runs_of_all(parts) == [periodic.runs(p) for p in parts]


def test_chunks_and_pieces_end_anywhere(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_BYTES", 5)
    monkeypatch.setattr(periodic, "CHUNK", 1)
    texts = [b"aaaa bbbb", b"a bb", b"a bb ccc dddd eeeeeeeeeee f", b"", b" \n", b"x" * 20 + b" y", b"\xc3\xa4\xc2\xa0b c"]
    words = periodic._Words(texts)
    for i, t in enumerate(texts):
        own = np.arange(words.first[i], words.first[i + 1])
        assert words.joined(own) == b" ".join(t.split())
        assert words.joined(own[::-1]) == b" ".join(t.split()[::-1])
    codes = np.array([0, 1, 2] * 30)
    assert periodic.runs(codes) == [(0, 90, 3)]


def test_op12_equals_brute_force(spark, sf_dir):
    got = queries.QUERIES["op12_harmonic_grid_runs"](spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert by_repr(got.collect()) == by_repr(brute_op12(*r) for r in docs)


def test_periodic_runs_of_odd_rows(spark):
    long = "one two three " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 9), (4, "a " * 9), (None, "b c " * 5), (5, long), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "mine", [1]) for r in rows], "doc_id long, text string, collapsed string, runs array<int>")
    found = {(r.doc_id, r.n_words): r for r in periodic.periodic_runs(docs).collect()}
    assert found[1, 0].runs == [] and found[1, 0].strongest is None and found[1, 0].collapsed == ""
    assert found[4, 9].collapsed == "a" and [tuple(r) for r in found[4, 9].runs] == [(0, 9, 1)]
    assert found[None, 10].collapsed == "b c" and found[5, 180_000].collapsed == "one two three"
    assert periodic.periodic_runs(docs).count() == len(rows) and len(found[6, 1].collapsed) == 300_000
    assert periodic.periodic_runs(docs.where("false")).collect() == []


# pages: links of all kinds, a chain over three hosts, a class with an allow and one without
PAGES = [
    (1, "http://a.net/es/1?ref=x", None),
    (2, "https://b.org/p", '<html><link href="http://a.net/es/1" rel="canonical"></html>'),
    (3, "https://c.org/q/", "<meta http-equiv='refresh' content='0; URL=https://b.org/p?utm_source=y#z'>"),
    (4, "https://c.org/q#top", ""),
    (5, "https://d.org/free", '<LINK REL=canonical HREF="//x.net/fr/7">'),
    (6, "https://d.org/free", '<link rel="canonical" href="https://ok.com/home">'),
    (7, "https://x.net/de/1", '<link rel="canonical" href="/es/9?a=1&amp;b=2">'),
    (8, "https://y.net/es", '<link rel="stylesheet" href="https://a.net/es/1">'),
    (9, "https://y.net/es/", None),
    (10, "ftp://www.EXAMPLE.com:21/en/x", None),
    (20, "ftp://www.EXAMPLE.com/en/x", None),
    (11, "https://example.com/en/x", None),
    (12, "https://e.org/", '<link rel="canonical" href="mailto:me"><meta http-equiv="refresh" content="5">'),
    (13, None, '<link rel="canonical" href="https://a.net/es/1">'),
    (14, "no url", '<link rel="canonical" href="x">'),
    (14, "no url", None),
    (None, "HTTPS://Q.net:443/fr/x://y?u=1", None),
    (15, "https://q.org/dir/one", '<link rel="canonical" href="two">'),
    (16, "https://q.org/dir/two?utm_medium=1", '<link rel=canonical href=http://z.net/fr/2>'),
    (17, "https://netblock/es/1", "é" * 10),
    (18, "https://u.org?page=1", '<link rel="canonical" href="?page=2">'),
    (19, "https://u.org/?page=2&ref=q", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "mine") for p in PAGES], "page_id long, url string, html string, verdict string")


def test_verdicts_reach_aliases(pages):
    got = {(r.page_id, r.url): (r.rule, r.verdict, r.own_class) for r in url_rules.judged(pages).join(pages.select(F.col("page_id"), "url").distinct(), "page_id").collect()}
    verdict = {k[0]: v for k, v in got.items()}
    assert verdict[1] == ("net/es/", "block", False)
    assert verdict[2] == verdict[3] == verdict[4] == (None, "block", True)  # by a canonical link, a refresh, a spelling
    assert verdict[5] == verdict[6] == (None, "allow", False)  # the class has an explicit allow as well
    assert verdict[7] == (None, "block", True)  # by a link whose target is no page
    assert verdict[8] == (None, "block", True) and verdict[9] == ("net/es/", "block", False)
    assert verdict[10] == (None, "allow", False) and verdict[20] == ("www.example.com/en/", "allow", False) and verdict[11] == ("example.com/en/", "block", False)
    assert verdict[12] == verdict[13] == verdict[14] == (None, "allow", False)
    assert verdict[15] == verdict[16] == (None, "block", True)
    assert verdict[17] == (None, "allow", False)


def test_op11_sql_and_query_agree_on_links(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op11_redirect_equivalence"](spark, str(tmp_path))
    held = duckdb.connect()
    held.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert by_repr(got.collect()) == by_repr(held.sql(f"select page_id, host, path, rule, verdict from ({queries.ORACLES['op11_redirect_equivalence']})").fetchall())
    assert got.count() == len(PAGES)
    host = {r.page_id: (r.host, r.path) for r in got.collect()}
    assert host[10] == ("www.example.com:21", "/en/x") and host[None] == ("q.net:443", "/fr/x://y") and host[13] == host[14] == ("", "")


def test_redirect_tables_and_long_chains(spark):
    rows = spark.createDataFrame([(i, f"https://h{i}.org/", None) for i in range(60)] + [(99, "https://s.net/es/", None)], "page_id long, url string, html string")
    hops = [(f"http://h{i}.org", f"https://h{i + 1}.org/") for i in range(39)] + [("https://h39.org", "https://s.net/es/"), (None, "https://h50.org"), ("https://h51.org", None)]
    got = {r.page_id: r.verdict for r in url_rules.judged(rows, redirects=spark.createDataFrame(hops, "src string, dst string")).collect()}
    assert all(got[i] == "block" for i in range(40)) and all(got[i] == "allow" for i in range(40, 60)) and got[99] == "block"
    # an allow anywhere in the class comes before the block
    more = spark.createDataFrame([*hops, ("https://h7.org", "https://fine.com/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_rules.judged(rows, redirects=more).collect()}
    assert got[5] == got[39] == "allow" and got[99] == "block"


def test_ties_of_rules_and_an_empty_table(spark, pages):
    both = (url_rules.Rule("block", "t.org", "/a"), url_rules.Rule("allow", "t.org", "/a"), url_rules.Rule("block", "t.org", "/"))
    one = spark.createDataFrame([(1, "http://x.t.org/ab", None), (2, "http://t.org/b", None), (3, "http://tt.org/b", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_rules.judged(one, both).collect()} == {1: ("t.org/a", "allow"), 2: ("t.org/", "block"), 3: (None, "allow")}
    assert url_rules.judged(pages.where("false")).collect() == []


def test_a_native_plan_has_no_python(spark, sf_dir):
    plan = url_rules.judged(table(spark, sf_dir, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x - total) ** 2).sum(axis=1), centred @ axes / np.sqrt(values), values / values.sum()


def test_op13_equals_numpy(spark, sf_dir):
    got = queries.QUERIES["op13_chan_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    deviation, white, explained = brute_whitening([r.embedding for r in rows])
    k = 32
    assert len(got) == len(rows) * k and list(got.component[:k]) == list(range(1, k + 1)) and got.n.unique().tolist() == [len(rows)]
    assert (got.deviation.to_numpy() == np.repeat(deviation, k)).all()
    mine = got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((mine * white[:, :k]).sum(axis=0))
    assert np.allclose(mine, white[:, :k] * sign, rtol=1e-7, atol=1e-9)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), explained[:k], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_merged_statistics_do_not_depend_on_the_parts():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(500, 7)) * 50).astype(np.int64) + 1_000_000
    for cuts in ([], [1], [3, 4, 499], list(range(1, 500, 50))):
        held = None
        for part in np.split(x, cuts):
            held = whitening.merged(held, whitening.stats_of(part))
        assert held[0] == 500 and held[1].tolist() == x.sum(axis=0).tolist()
        assert np.allclose(held[2], x.mean(axis=0), rtol=1e-14) and np.allclose(held[3], np.cov(x.T, bias=True) * 500, rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1 * i, -0.2 * (i % 3), float(i % 5 == 0)] for i in range(40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(50, None), (51, [nan, 1.0, 1.0]), (52, [1.0, None, 1.0]), (53, [inf, 0.0, 0.0]), (54, [1.0, 2.0]), (55, []), (3, good[3]), (None, good[4])]
    held = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, whitened string")
    got = whitening.whitened(held).toPandas()
    assert len(got) == 42 * 3 and set(got.component) == {1, 2, 3} and (got.n == 42).all() and got.identity_error.max() < 1e-9
    deviation, _, explained = brute_whitening([*good, good[3], good[4]])
    assert {(int(i), int(d)) for i, d in zip(got.vec_id.fillna(-1), got.deviation, strict=True)} == set(zip([*range(40), 3, -1], deviation.tolist(), strict=True))
    assert np.allclose(got.groupby("component").explained.first(), explained)
    assert whitening.whitened(held.where("false")).collect() == []
    assert whitening.whitened(held.where("vec_id = 3")).collect() == []  # equal vectors have no direction
    flat = spark.createDataFrame([(i, [0.5 * i, 1.0 * i, 3.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}


def test_deviations_beyond_64_bits():
    x = np.array([[1_000_000, -(1 << 42)], [3_000_000, 1 << 42]])
    model = whitening.Whitening(1 << 30, np.array([5, 7], object), None, None, None, 1.0)
    want = [sum(((1 << 30) * int(v) - s) ** 2 for v, s in zip(r, (5, 7), strict=True)) for r in x]
    with pytest.raises(Exception):
        whitening.deviations(model, x)  # over 38 digits
    model.n = 1 << 12
    want = [sum(((1 << 12) * int(v) - s) ** 2 for v, s in zip(r, (5, 7), strict=True)) for r in x]
    assert [int(v) for v in whitening.deviations(model, x).to_pylist()] == want
