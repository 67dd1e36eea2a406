"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from logfold.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, "Hello, WÖRLD  hello", "ÀB\x7fc d 😀 e", "a" * 50, " , ", "one two three four " * 12, "one two three four " * 12,
       "Straße\tÅngström—x\x00y 12_3"]


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text, top):
    w = words_of(text)
    return [" ".join(w[i:i + m]) for m in range(1, top + 1) for i in range(len(w) - m + 1)]


def by_definition(docs, target, top=1, buckets=10_000, min_words=20, percent=10, seed="2024"):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features_of(text, top):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        found = features_of(text, top)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
                     len(words_of(text)), i])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


@pytest.mark.parametrize("top", [1, 3])
def test_every_document(spark, docs, doc_rows, sf, top):
    aim = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = importance.resample(docs, aim, max_words=top, buckets=977, percent=30)
    want = by_definition([(r.doc_id, r.text) for r in doc_rows], [r.text for r in aim.collect()], top, 977, percent=30)
    assert rows_of(found) == want


def test_odd_rows_and_clashing_columns(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(None, ODD[6]), (7, ODD[6]), (6, ODD[6])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, total int, buckets string")
    aim = spark.createDataFrame([(1, "two three", 5), (2, None, 6)], "item_id long, text string, counts int")
    found = rows_of(importance.resample(df, aim, percent=60, min_words=2))
    assert found == by_definition(rows, ["two three", None], percent=60, min_words=2)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, aim).collect() == []
    rows = [(1, "a b " * 20), (2, "a c " * 20)]
    found = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), aim, percent=50)
    assert rows_of(found) == by_definition(rows, [], percent=50)


@pytest.mark.parametrize("top", [1, 2, 4])
def test_blocks_of_a_long_text_change_nothing(monkeypatch, top):
    text = " ".join(f"w{i % 7} Ä{i % 3},x" for i in range(300)) + "y" * 500 + " end of it"
    whole = importance.WordWindows(top, 501).histogram(text)
    for size in (1, 7, 64, 301):
        monkeypatch.setattr(importance, "BLOCK_CHARS", size)
        got = importance.WordWindows(top, 501).histogram(text)
        assert got[:2] == whole[:2] and all(np.array_equal(a, b) for a, b in zip(got[2:], whole[2:], strict=True))
    want = sorted(zlib.crc32(f.encode()) % 501 for f in features_of(text, top))
    assert sorted(np.repeat(whole[2], whole[3]).tolist()) == want


def test_bucket_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(importance, "CACHE_FEATURES", 5)
    cache = importance.BucketOf(1000)
    assert [cache[f"w{i}"] for i in range(40)] == [zlib.crc32(f"w{i}".encode()) % 1000 for i in range(40)] and len(cache) <= 5


def test_very_common_score_and_id_spread_over_partitions(spark):
    """A third of all rows is one row: every rank is given once, whatever partition it lies in."""
    rows = [(1, "same words here " * 10)] * 40 + [(i, f"w{i} other words " * 10) for i in range(2, 82)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = importance.resample(df, spark.createDataFrame([(1, "same words")], "item_id long, text string"), percent=70)
    assert rows_of(found) == by_definition(rows, ["same words"], percent=70)
    assert sorted(r["rank"] for r in found.collect() if r["rank"]) == list(range(1, 85))
