"""Counts by definition, exact binomial bounds, and certified cutoffs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logfold.llm import quality
from logfold.staging import stage


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


ODD = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", " lead trail ", "é😀 # | <\u00a0>",
       "a a a b a a a", "one\rtwo\x0bthree\x1ffour", "w x y z " * 3000, "!" * 50000, "\n" * 500 + "l\n" * 3]


def test_counts_by_definition(spark, doc_rows):
    rows = [(k, t) for k, t in enumerate(ODD + [r.text for r in doc_rows])]
    df = spark.createDataFrame([(*r, "en", 5, "c") for r in rows], "doc_id long, text string, lang string, _words int, stratum string")
    got = {r.id: r for r in quality.features(df).collect()}
    for k, t in rows:
        r, want = got[k], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (k, (t or "")[:60])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


@pytest.mark.parametrize("p", [0.01, 0.3])
def test_binomial_bound_is_exact(spark, p):
    cases = [(n, k) for n in (0, 1, 7, 300, 3000) for k in (0, 1, 5, 40) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_cdf(F.col("n"), F.col("k"), p).alias("c"))
    for r in df.collect():
        want = math.fsum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert r.c == pytest.approx(want, rel=1e-9, abs=1e-300)


def make(spark, good, bad_text, stratum="en"):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, clean, stratum, 1) for i in range(good)]
    rows += [(good + i, bad_text, stratum, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_cutoffs_need_enough_labels_and_then_reject(spark):
    bad = " ".join(f"w{i}##" for i in range(60))
    for good, sure in ((300, False), (2000, True)):
        docs, labels = make(spark, good, bad)
        rows = quality.quality(docs, labels).collect()
        assert all(r.kept for r in rows if r.id < good)
        assert all(r.kept != sure for r in rows if r.id >= good)
        kept = quality.keep_good(docs, labels)
        assert kept.columns == docs.columns and kept.count() == (good if sure else good + 40)


def test_strata_labels_and_empty_tables(spark):
    docs, labels = make(spark, 2000, " ".join(f"w{i}##" for i in range(60)), None)
    labels = labels.unionAll(spark.createDataFrame([(None, 0), (5, None), (2001, 1)], "doc_id long, quality int"))
    rows = quality.quality(docs, labels).collect()
    assert sum(not r.kept for r in rows) == 40  # the null stratum has cutoffs of its own
    none = labels.where("doc_id < 0")
    assert all(r.kept for r in quality.quality(docs, none).collect())
    assert quality.quality(docs.where("doc_id < 0"), labels).collect() == []
    assert quality.keep_good(docs.where("doc_id < 0"), labels).collect() == []


def test_bound_holds_for_every_stratum(spark):
    """Simulated labels: many strata whose true false rejection rate lies just above what is allowed.

    With the budget ``error`` x strata each stratum is a trial of its own; the certified share of
    strata with a rate beyond the allowed one must stay within the error, with room for chance.
    """
    strata, n, allowed = 300, 2500, quality.MAX_FALSE / len(quality.GRID)
    rate = {0.05: 4 * allowed, 0.1: 2 * allowed, 0.2: 1.05 * allowed, 0.3: 1.02 * allowed, 0.5: 0.2 * allowed, 1.0: 0.1 * allowed}
    u = F.rand(5)
    cut = F.lit(0.0)
    for c in sorted(rate):  # a text's symbol rate exceeds cutoff c with chance rate[c]
        cut = F.when(F.col("u") < rate[c], F.lit(c + 1e-3)).otherwise(cut)
    rows = spark.range(strata * (n + 200)).select(
        "id", (F.col("id") % strata).cast("string").alias("stratum"), (F.col("id") < strata * n).alias("good"), u.alias("u"))
    # Bad texts lie between all cutoffs: a stricter one rejects more of them, so the strictest certified one is taken.
    between = F.element_at(F.array(*[F.lit(x) for x in (0.07, 0.15, 0.25, 0.35, 0.6, 2.0)]), (F.floor(F.col("id") / strata) % 6 + 1).cast("int"))
    rows = rows.withColumn("r", F.when(F.col("good"), cut).otherwise(between))
    labels = stage(rows.select(F.col("id").alias("doc_id"), F.col("good").cast("int").alias("quality")), "t")
    feats = stage(rows.select(
        "id", "stratum", F.lit(1000).cast("long").alias("n_words"), F.lit(5000).cast("long").alias("word_chars"),
        (1000 * F.col("r")).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_marks"), F.lit(10).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(False).alias("base_failed")), "t")
    error = 0.05
    found = quality.fit_thresholds(feats, labels, error=error * strata, cost=0, grid={"symbols": quality.GRID["symbols"]},
                                   max_false=allowed).collect()
    cutoffs = [r.cutoffs["symbols"] for r in found]
    assert len(cutoffs) > 0.9 * strata  # the rates far below the allowed one are certified
    broken = sum(rate[c] > allowed for c in cutoffs)
    assert broken <= strata * error + 4 * math.sqrt(strata * error)


def test_fixed_sequence_stops_at_the_first_failure(spark):
    """A strict cutoff that passes behind a lenient one that does not is not certified; the budget is one per rule."""
    clean, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}##" for i in range(60))
    rows = [(i, clean, "en", 1) for i in range(700)] + [(700 + i, bad, "en", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    feats = stage(quality.features(df), "t")
    # 0.99^700 lies between 0.05 / 5 (one budget a rule) and 0.05 / 24 (one a cutoff) times a fifth.
    found = quality.fit_thresholds(feats, df.select("doc_id", "quality")).collect()
    assert found and found[0].cutoffs == {"symbols": 1.0}
    worse = df.withColumn("text", F.when(F.col("doc_id") < 30, F.lit(bad)).otherwise(F.col("text")))
    assert quality.fit_thresholds(stage(quality.features(worse), "t"), df.select("doc_id", "quality")).collect() == []


def test_sql_where_cutoffs_are_certified(spark, tmp_path):
    """The query's SQL on a table of its own with labels enough, two strata and a null one."""
    import random

    import duckdb

    from logfold.llm.oracles import OP2

    rnd, rows = random.Random(3), []
    for i in range(5200):
        lang, good = rnd.choice(["en", "de", None]), rnd.random() < 0.9
        words = [f"w{rnd.randrange(40)}{'#!'[rnd.randrange(2)] * rnd.choice([0, 0, 1]) if not good else ''}" for _ in range(62)]
        words += [f"u{k}" for k in range(50)] + (["!!!"] * 3 if rnd.random() < 0.01 else [])
        rows.append((i, " ".join(words), lang, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    df.select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents"))
    df.select("doc_id", "quality").write.parquet(str(tmp_path / "labels"))
    docs, labels = (spark.read.parquet(str(tmp_path / t)) for t in ("documents", "labels"))
    got = {r.id: (r.n_words, r.n_symbols, r.base_failed, r.kept) for r in quality.quality(docs, labels).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}/*.parquet')")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_words, n_symbols, base_failed, kept FROM ({OP2})").fetchall()}
    assert got == want
    cut = quality.fit_thresholds(stage(quality.features(docs), "t"), labels).collect()
    assert len(cut) >= 2 and sum(not k and not b for *_, b, k in got.values()) > 50
