"""Trained operators: held-out accuracy, isolation of held-out labels and edge cases; and the pipeline as a whole."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import features, langid, nbsvm, nnpu, tokens
from lorekeep.llm.common import fold, table

from test_exact import brute_shards, brute_simhash

SF = "/root/testdata/sf0.01"


def held_out(spark, found, label):
    rows = found.join(table(spark, SF, "labels"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[label] for r in rows])


def test_quality_classifier(spark):
    found = nbsvm.op7_naive_bayes_svm(spark, SF)
    score, predicted, y = held_out(spark, found, "quality")
    assert (predicted == y).mean() > 0.95 and ((0 <= score) & (score <= 1)).all()
    assert found.count() == table(spark, SF, "documents").count()


def test_toxicity(spark):
    score, predicted, y = held_out(spark, nnpu.op2_nn_pu(spark, SF), "toxic")
    assert score[y == 1].mean() > score[y == 0].mean() + 0.3
    assert predicted[y == 0].mean() < 0.05 and predicted[y == 1].mean() > 0.4  # 37 positives to learn from


def test_language(spark):
    docs = table(spark, SF, "documents")
    found = langid.op3_ftrl_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_are_not_read(spark):
    """Other labels in the held-out fold give the same model."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (nbsvm.train(docs, x, usable=fold(F.col("doc_id"), 3) != 1) for x in (labels, turned))
    assert np.array_equal(a.weight, b.weight) and (a.a, a.b, a.bias) == (b.a, b.b, b.bias)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, 1), (2, "", "en", 2), (3, "12 34 !!", "en", 3), (None, "the cat and the dog", "en", 4), (5, "x" * 300_000, None, 5), (5, "x" * 300_000, None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


def test_edges(spark, odd):
    none = table(spark, SF, "labels").limit(0)
    empty = nbsvm.train(odd, none)
    got = nbsvm.scored(odd, empty, 0.5).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    model = nnpu.train(odd, none, F.lit(True))
    assert nbsvm.scored(odd, model, 0.3).count() == 6
    lang = langid.train(table(spark, SF, "documents"), F.lit(True))
    got = {r.doc_id: r for r in langid.identify(odd, lang).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert langid.identify(odd.limit(0), lang).count() == 0 and nbsvm.scored(odd.limit(0), empty, 0.5).count() == 0
    assert langid.train(odd.limit(0), F.lit(True)).predict("text") == ("und", 0.0)


def test_slices_count_every_gram(monkeypatch):
    text = "Über das Meer " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "SLICE", 37)
    assert np.array_equal(langid.gram_counts(text), whole)


def test_long_texts_have_the_same_indicators(monkeypatch):
    rng = np.random.default_rng(3)
    text = b" ".join(b"w%d" % k for k in rng.integers(0, 5000, 20_000)) + b", end!!\n"
    for ngrams in (nbsvm.NGRAMS, nnpu.NGRAMS):
        doc, bucket = ngrams.of([text])
        monkeypatch.setattr(features, "SLICE_BYTES", 100)
        monkeypatch.setattr(tokens, "SLICE_BYTES", 777)
        long_doc, long_bucket = ngrams.of([text])
        monkeypatch.undo()
        assert not long_doc.any() and not doc.any()
        if ngrams is nbsvm.NGRAMS:
            assert np.array_equal(bucket, long_bucket)
        else:  # byte n-grams that hold the end of a slice are those of a line's end
            assert np.isin(bucket, long_bucket).mean() > 0.99


def test_repeated_ids_bound_a_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = features.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.y, r.text or "") for r in got) == [(1, 1, "text 0"), (2, 0, "b"), (3, 1, "")]


def test_scores_are_those_of_the_fitted_weights(spark):
    """Quality, toxicity and language of whole tables, row by row from the fitted weights in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    quality, toxic = nbsvm.train(docs, labels, usable=fold(F.col("doc_id"), 3) != 1), nnpu.train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    for query, model, limit in ((nbsvm.op7_naive_bayes_svm, quality, 0.5), (nnpu.op2_nn_pu, toxic, 0.3)):
        got = {r.doc_id: (r.score, r.predicted) for r in query(spark, sf).collect()}
        assert len(got) == len(rows)
        for i, text in rows:
            buckets = sorted(set(model.ngrams.of([(text or "").encode()])[1].tolist()))
            margin = sum(float(model.weight[b]) for b in buckets)
            if model is quality:
                margin = model.a * (margin / max(math.sqrt(sum(float(model.ratio[b]) ** 2 for b in buckets)), 1e-9) + model.bias) + model.b
            else:
                margin += model.bias
            score = 1 / (1 + math.exp(-min(max(margin, -35), 35)))
            assert abs(got[i][0] - score) < 1e-6 and got[i][1] == int(got[i][0] >= limit)
    model = langid.train(docs, fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op3_ftrl_langid(spark, sf).collect()}
    for i, text in rows:
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        counts = langid.gram_counts(text)
        x = {b: math.log1p(counts[b]) * model.idf[b] for b in np.flatnonzero(counts).tolist()}
        length = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / length * model.weight[b, k] for b, v in x.items()) + model.weight[-1, k]) / model.temperature for k in range(len(model.classes))]
        best = max(range(len(z)), key=lambda k: (z[k], -k))
        assert got[i][0] == model.classes[best] and abs(got[i][1] - 1 / sum(math.exp(v - z[best]) for v in z)) < 1e-6


def test_rare_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MIN_CLASS_ROWS", 30)
    rows = [(k, f"the house and the garden are in the town {k}", "en") for k in range(3000)] + [(9000 + k, f"talo ja puutarha ovat kaupungissa {k}", "fi") for k in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), max_rows=100)
    assert model.classes == ["en", "fi"] and model.predict("puutarha on kaupungissa")[0] == "fi"


def test_clean_labels_are_no_examples(spark):
    """Under a given prior the model is the same without them."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    usable = fold(F.col("doc_id"), 4) != 2
    a, b = (nnpu.train(docs, x, usable, prior=0.04) for x in (labels, labels.where("toxic = 1")))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_corpus_counts_cover_all_rows(spark):
    """The counts that screen indicators equal a count text by text, over nulls, repeated rows and any partitions."""
    docs = table(spark, SF, "documents").select("text").limit(50)
    docs = docs.unionByName(docs).unionByName(spark.createDataFrame([(None,), ("",)], "text string")).repartition(5)
    texts = [(r.text or "").encode() for r in docs.collect()]
    want = sum(np.bincount(nnpu.NGRAMS.of([t])[1], minlength=1 << nnpu.NGRAMS.bits) for t in texts)
    got, rows = features.corpus_counts(docs, nnpu.NGRAMS)
    assert rows == len(texts) == 102 and np.array_equal(got, want)
    got, rows = features.corpus_counts(docs.limit(0), nnpu.NGRAMS)
    assert rows == 0 and not got.any()


def test_temperature_and_platt():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert abs(langid.temperature(4 * z, y) - 4) < 0.5
    m = rng.normal(size=4000)
    a, b = features.platt(m, (rng.random(4000) < features.sigmoid(2 * m - 1)).astype(int))
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3


def test_non_negative_risk():
    """Positives against a mix that holds them: the screened indicator carries the score."""
    rng = np.random.default_rng(0)

    def rows(texts, y):
        doc, bucket = nnpu.NGRAMS.of(texts)
        return features.Rows(bucket, np.searchsorted(doc, np.arange(len(texts) + 1)), np.full(len(texts), y))

    plain = lambda: " ".join(f"w{k}" for k in rng.integers(0, 400, 20))
    p = rows([f"{plain()} badword".encode() for _ in range(200)], 1)
    u = rows([(plain() + (" badword" if i % 10 == 0 else "")).encode() for i in range(1500)], 0)
    size = 1 << nnpu.NGRAMS.bits
    used = nnpu.telling(np.bincount(p.bucket, minlength=size), np.bincount(u.bucket, minlength=size), 200, 1500)
    keep = lambda r: features.Rows(r.bucket[m := np.isin(r.bucket, used)], np.r_[0, np.cumsum(np.bincount(r.doc[m], minlength=len(r.y)))], r.y)
    model = nnpu.fit(keep(p), keep(u), 0.1, used)
    bad, good = model.scores([b"w1 w2 badword", b"w1 w2 w3"])
    assert bad > 0.8 and good < 0.2


def brute_windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    n = min(10, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def test_pipeline(spark):
    """Every stage on its own input against plain Python: rejects by the model's scores, groups by all pairs of fingerprints, windows of words,
    words by source, and the shards' order, none of it with the stage's operators."""
    sf = "/root/testdata/sf0.001"
    docs, stages = table(spark, sf, "documents"), dict(corpus_pipeline.STAGES)
    names = docs.columns
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    model = nbsvm.train(docs, table(spark, sf, "labels"))
    good = stages["quality_classifier"](spark, docs, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    want = {i for i, r in rows.items() if model.scores([(r.text or "").encode()])[0] >= 0.5}
    assert {r.doc_id for r in good.collect()} == want and good.columns == names
    one = stages["simhash_near_dedup"](spark, good, sf)
    expected = {c for _, _, c in brute_simhash([(i, rows[i].text) for i in want])}
    assert sorted(r.doc_id for r in one.collect()) == sorted(expected) and one.columns == names
    clean = stages["benchmark_decontamination"](spark, one, sf)
    items = set().union(*(brute_windows(r.text) for r in table(spark, sf, "benchmark").collect()))
    short = {w for w in items if len(w) < 10}
    assert not short and clean.columns == names
    left = {i for i in expected if not brute_windows(rows[i].text) & items}
    assert {r.doc_id for r in clean.collect()} == left
    mixed = stages["source_mixing"](spark, clean, sf)
    times = Counter(r.doc_id for r in mixed.collect())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or "")) for i in left}
    total, longest = Counter(), Counter()
    for i in left:
        total[rows[i].source] += size[i]
        longest[rows[i].source] = max(longest[rows[i].source], size[i])
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight, target, open_, rest = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}, {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {x: rest * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 2 * total[x]}
        target |= {x: 2.0 * total[x] for x in full} or share
        rest, open_ = rest - sum(2.0 * total[x] for x in full), open_ - full if full else set()
    assert set(times) <= left and max(times.values()) <= 2 and mixed.columns == names
    for x in order:
        assert abs(sum(size[i] * times[i] for i in left if rows[i].source == x) - target[x]) <= longest[x]
    sharded = stages["sharding"](spark, mixed, sf)
    assert sharded.columns == [*names, "shard"]
    plan = brute_shards([(i, (rows[i].text or "").encode()) for i, n in times.items() for _ in range(n)])
    shard_of = {}  # equal rows stay together, in the later shard
    for i, _, _, k, _ in plan:
        shard_of[i] = max(int(k), shard_of.get(i, 0))
    assert Counter((r.doc_id, r.shard) for r in sharded.collect()) == Counter((i, shard_of[i]) for i, n in times.items() for _ in range(n))


def test_pipeline_edges(spark):
    """Nulls in all columns, clashing names, repeated rows and empty tables through all stages."""
    sf = "/root/testdata/sf0.001"
    clash = {n: F.lit("mine") for n in ("copies", "target", "p", "v", "n_words", "contaminated", "size", "component", "fp", "score", "predicted", "shard")}
    working = ("__mix", "__mix_source", "__mix_size", "__mix_u", "__mix_p", "__mix_v", "__mix_plan", "__mix_part", "__mix_copy", "__near_hash", "__near_id", "__near_n", "__leak", "__leak_row", "__leak_hit", "__score", "__kept", "row", "leak", "n_hit", "y", "digest", "a.b", "odd `name`")
    clash |= {n: F.lit(f"mine {n}") for n in working}
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, None, 1), (2, "a b c", None, None, 1), (None, "a b c", "en", "s", 2)], table(spark, sf, "documents").schema)
    docs = table(spark, sf, "documents").unionByName(odd)
    docs = docs.select("*", *(v.alias(k) for k, v in clash.items()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        names = docs.columns if name != "sharding" else [*[c for c in docs.columns if c != "shard"], "shard"]
        assert out.columns == names
        kept = out.drop("shard").distinct()
        assert kept.exceptAll(docs.drop("shard").distinct()).isEmpty()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got) and math.isfinite(len(got))
