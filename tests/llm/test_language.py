"""Language identification: held-out accuracy, folds, undefined texts, long texts in blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from logfold.llm import language


def test_held_out_accuracy_and_fold(spark, docs):
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.id] for r in held) >= 0.9 * len(held)


def test_held_out_rows_are_not_learned_from(spark, docs):
    import pyspark.sql.functions as F

    changed = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(changed)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_undefined_texts_null_ids_and_clashing_columns(spark, docs):
    model = language.fit(docs)
    df = spark.createDataFrame([(None, None, 1), (2, "123 !?", 2), (3, "", 3), (4, "the and of thing", 4), (4, "the and of thing", 4)],
                               "doc_id long, text string, score int")
    rows = sorted(language.predict(df, model).collect(), key=lambda r: (r.id is not None, r.id))
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[0].held_out and rows[0].score == 0
    assert rows[3].lang_pred == "en" and rows[3] == rows[4]
    kept = language.keep_known(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4, 4]
    nothing = language.fit(docs.where("lang is null"))
    assert nothing is None and {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.where("doc_id > 9"), model).collect() == []


def test_counts_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = "Der Öl-Preis, ça va? 𝔘nd 1 " * 50
    whole = language.NGrams().counts(text)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(language, "_CHARS", block)
        got = language.NGrams().counts(text)
        assert np.array_equal(whole[0], got[0]) and np.array_equal(whole[1], got[1])


def test_temperature_is_the_best_of_a_scan():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    logits = 6 * np.eye(3)[(y + (rng.random(300) < 0.2)) % 3]
    t = language._temperature(logits, y)

    def loss(u):
        p = language._softmax(logits / u)
        return -np.log(p[np.arange(300), y]).mean()

    assert loss(t) <= min(loss(u) for u in np.exp(np.linspace(-2.9, 2.9, 400))) + 1e-6


GREEK = "ο γρήγορος σκύλος τρέχει στο δάσος και η γάτα κοιμάται στο σπίτι"


def test_rare_languages_are_learned(spark, docs):
    from pyspark.sql import functions as F

    many = docs.crossJoin(spark.range(10).withColumnRenamed("id", "k")).select((F.col("doc_id") * 10 + F.col("k")).alias("doc_id"), "text", "lang")
    late = spark.range(10**6, 10**6 + 5000).withColumnRenamed("id", "doc_id").where(~language.held_out()).orderBy(
        F.xxhash64(F.col("doc_id").cast("string"), F.lit(GREEK)).desc()).limit(4).collect()  # a plain hash sample takes these last
    greek = GREEK
    df = many.unionAll(spark.createDataFrame([(r.doc_id, greek, "el") for r in late], "doc_id long, text string, lang string"))
    model = language.fit(df, sample_rows=300)
    assert "el" in model.languages and set(model.languages) - {"el"} == {r.lang for r in docs.select("lang").distinct().collect()}
    got = language.predict(spark.createDataFrame([(1, greek), (2, "the and of thing that with")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in sorted(got.collect())] == ["el", "en"]


def test_many_languages_are_learned_or_refused(spark):
    df = spark.range(1500).selectExpr("id as doc_id", "concat('word ', char(97 + id % 26)) as text", "concat('l', id % 300) as lang")
    assert len(language.fit(df, max_languages=300).languages) == 300
    with pytest.raises(ValueError, match="256"):
        language.fit(df)


def test_quotas_keep_the_bound():
    for counts, size in (({"a": 10**6, "b": 3, "c": 900}, 3000), ({"a": 5, "b": 2}, 3000), (dict.fromkeys(range(256), 10**6), 300),
                         ({"a": 10**9, "b": 10**9}, 3000)):
        got = language._quotas(counts, size)
        assert got.keys() == counts.keys() and all(1 <= got[k] <= n for k, n in counts.items())
        assert min(size, sum(counts.values())) - len(counts) <= sum(got.values()) <= size


def test_a_repeated_row_is_sampled_once(spark, docs):
    """One row repeated 20 000 times neither fills the sample nor reaches the last choice more than once a task."""
    hot = spark.range(20_000).selectExpr("7 as doc_id", "'one text of a very common id the and of' as text", "'en' as lang")
    df = docs.select("doc_id", "text", "lang").unionAll(hot).repartition(4)
    seen = []
    keep, language.stage = language.stage, lambda d, name: seen.append((name, out := keep(d, name))) or out
    try:
        model = language.fit(df, sample_rows=300)
    finally:
        language.stage = keep
    rows = dict(seen)["language-grams"].where("lang is not null")
    assert rows.count() <= 300 + 4 * 70 + 4 and rows.groupBy("lang", "h").count().agg({"count": "max"}).first()[0] <= 4
    assert model.languages == language.fit(docs).languages


def plain_grams(text):
    """Bucket counts of the 1- to 3-grams, gram by gram in 32-bit arithmetic."""
    m = 0xFFFFFFFF
    c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
    if not any(x.isalpha() for x in text.lower()):
        return None
    out = {}
    for n, salt in ((1, 0), (2, 0x27D4EB2F), (3, 0x165667B1)):
        for i in range(len(c) - n + 1):
            g = [x * 0x9E3779B1 & m for x in c[i:i + n]]
            h = g[0] if n == 1 else (g[0] * 0x85EBCA6B + g[1]) & m
            if n == 3:
                h = (h * 0xC2B2AE35 + g[2]) & m
            h ^= salt
            h ^= h >> 15
            h = h * 0x2C1B3C6D & m
            out[h >> 18] = out.get(h >> 18, 0) + 1
    return out


def test_model_and_predictions_by_a_plain_version(spark):
    """TF-IDF, FTRL with elastic net and the calibrated softmax, written out number by number."""
    import math
    import random

    words = {"en": "the and of thing that with for".split(), "de": "der und die ding das mit für".split(), "fr": "le et de chose que avec pour".split()}
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(words[k], k=rnd.randint(3, 9))), k) for i in range(45) for k in [rnd.choice(list(words))]]
    rows += [(100, "123", "en"), (101, None, "en"), (102, "le et", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)

    learn = [(plain_grams(t), k) for i, t, k in rows if t and k and zlib.crc32(str(i).encode()) % 5 and plain_grams(t)]
    freq = {}
    for grams, _ in learn:
        for b in grams:
            freq[b] = freq.get(b, 0) + 1
    n, langs = max(freq.values()), sorted({k for _, k in learn})
    idf = {b: math.log((1 + n) / (1 + f)) + 1 for b, f in freq.items()}

    def vector(grams):
        x = {b: (1 + math.log(c)) * idf.get(b, math.log(1 + n) + 1) for b, c in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    data = [(vector(g), langs.index(k)) for g, k in sorted(((g, k) for g, k in learn),
                                                          key=lambda r: (r[1], sorted(r[0]), [r[0][b] for b in sorted(r[0])]))]
    z, s = {}, {}

    def weight(key):
        zi, si = z.get(key, 0.0), s.get(key, 0.0)
        if abs(zi) <= language.L1:
            return 0.0
        return -(zi - math.copysign(language.L1, zi)) / ((language.BETA + math.sqrt(si)) / language.ALPHA + language.L2)

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    order = np.random.default_rng(7)
    for _ in range(language.EPOCHS):
        for r in order.permutation(len(data)):
            x, y = data[r]
            x = {**x, "bias": 1.0}
            p = softmax([sum(v * weight((b, j)) for b, v in x.items()) for j in range(len(langs))])
            step = {(b, j): v * (p[j] - (j == y)) for b, v in x.items() for j in range(len(langs))}
            for key, g in step.items():
                w, old = weight(key), s.get(key, 0.0)
                z[key] = z.get(key, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language.ALPHA * w
                s[key] = old + g * g
    assert len(data) < 50 and model.languages == langs  # fewer than 50 rows: the temperature is set on the learned rows
    got = {r.id: r for r in language.predict(df, model).collect()}
    for i, t, _ in rows:
        grams = plain_grams(t) if t else None
        if grams is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = {**vector(grams), "bias": 1.0}
        p = softmax([sum(v * weight((b, j)) for b, v in x.items()) / model.temperature for j in range(len(langs))])
        assert got[i].lang_pred == langs[p.index(max(p))] and got[i].score == pytest.approx(max(p), rel=1e-6)
