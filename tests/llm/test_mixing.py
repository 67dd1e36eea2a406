"""Source mixing: targets, places and schedule against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from logfold.llm import mixing


def plain_targets(size_of: dict, weights=(3, 1, 2), share=Fraction(3, 2), repeats=2):
    """Share by weight, stop those above their cap, share the excess again until none is above."""
    names = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        left = share * sum(size_of.values()) - sum(repeats * size_of[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        target = {s: Fraction(repeats * size_of[s]) if s in stopped else left * weight[s] / free for s in names}
        above = {s for s in names if target[s] > repeats * size_of[s]}
        if not above:
            return target
        stopped |= above


def plain_taken(rows, block=None, **how):
    """Sorted (doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    size_of = Counter()
    for _, n, s in docs:
        size_of[s] += n
    target, out = plain_targets(size_of, **how), []
    for s in size_of:
        at = 0
        for _, n, i in sorted((hashlib.sha256(f"mix:{'' if i is None else i}".encode()).hexdigest(), n, i if i is not None else -1)
                              for i, n, x in docs if x == s):
            words = math.floor(target[s])
            got = sum(max(min(at + n, words - p * size_of[s]) - at, 0) for p in range(words // max(size_of[s], 1) + 1))
            out.append((None if i < 0 else i, n, size_of[s], float(target[s]), got))
            at += n
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in df.collect())


def test_documents_against_a_plain_pass(spark, docs, doc_rows):
    want = plain_taken([(r.doc_id, r.text, r.source) for r in doc_rows])
    assert rows_of(mixing.taken(mixing.mix(docs))) == want
    # Reruns agree whatever the partitions and blocks.
    assert rows_of(mixing.taken(mixing.mix(docs.repartition(5), block_words=37))) == want


ODD = [(1, None, "b"), (2, "", "b"), (3, "one two", None), (4, "x " * 500, "ä"), (5, "y " * 500, "Z"), (5, "y " * 500, "Z"),
       (5, "z", "Z"), (None, "w " * 90, "b"), (6, None, "empty"), (7, "v " * 3000, "ä"), (8, " \t\n", None)]


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_odd_rows_and_clashing_columns(spark, block):
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in ODD],
                               "doc_id long, text string, source string, s long, row long, key string")
    assert rows_of(mixing.taken(mixing.mix(df, block_words=block))) == plain_taken(ODD)


def test_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.taken(mixing.mix(spark.createDataFrame([], schema))).collect() == []
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)
    assert rows_of(mixing.taken(mixing.mix(df))) == ["(1, 0, 0, 0.0, 0)", "(2, 0, 0, 0.0, 0)"]


def test_other_weights_share_and_repeats(spark):
    rows = [(i, "w " * (7 * i % 50), f"s{i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"weights": (5, 1), "repeats": 4}
    found = mixing.taken(mixing.mix(df, share=(7, 3), block_words=8, **how))
    assert rows_of(found) == plain_taken(rows, share=Fraction(7, 3), **how)


def test_schedule_fills_every_slot_evenly(spark):
    """One source has a third of all words, most sources a few: slots are exact, ordered and evenly spread."""
    rows = [(i, "w " * 40, "hot") for i in range(200)] + [(1000 + i, "w " * (1 + i % 60), f"s{i % 150:03}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(df, block_words=4)
    slots, sources = mixing.schedule(m).collect(), {r.s: r for r in m.sources.collect()}
    assert len({r.slot for r in slots}) == len(slots) == sum(r.need for r in sources.values())
    by_source = defaultdict(list)
    for r in sorted(slots, key=lambda r: r.slot):
        by_source[r.s].append(r)
    n = 1 << (len(slots) - 1).bit_length()
    for s, got in by_source.items():
        src = sources[s]
        assert [r["rank"] for r in got] == list(range(src.need)) and sum(r.words for r in got) == src.limit
        assert all(r["pass"] == r["rank"] // src.blocks and r.block == r["rank"] % src.blocks for r in got)
        assert all(0 < r.words <= 4 for r in got)
        for cut in range(0, n, 97):  # the discrepancy of the first points grows with log2 n only
            seen = sum(r.slot < cut for r in got)
            assert abs(seen - cut * src.need / n) <= 2 * math.log2(n)
    # The segments of a slot are its words, and no word of a document is taken twice in a pass.
    filled, used = Counter(), defaultdict(list)
    for g in mixing.segments(m, mixing.schedule(m)).collect():
        filled[g.slot] += g.words
        used[g.row, g["pass"]].append((g.first, g.first + g.words))
    assert filled == {r.slot: r.words for r in slots}
    for spans in used.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_no_python_on_the_main_path(spark, docs):
    m = mixing.mix(docs)
    plan = mixing.taken(m)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|MapPartitions|CartesianProduct|NestedLoop", plan)
