"""Embedding near-duplicates against all pairs in double precision."""

from __future__ import annotations

import math

import numpy as np
import pytest
from brute import components

from logfold.llm import vectors


def expected(rows):
    """rows: (id, label, vector) -> (n_links, component) of each."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if k is not None and usable(v) else None for _, k, v in rows]
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            a, b = unit[i], unit[j]
            if a is None or b is None or rows[i][1] != rows[j][1] or len(a) != len(b):
                continue
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                pairs.append((i, j))
    links = np.zeros(n, int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    low = components(n, pairs)
    best = {}
    for i, root in enumerate(low):
        if rows[i][0] is not None:
            best[root] = min(best.get(root, rows[i][0]), rows[i][0])
    return [(int(links[i]), best.get(low[i])) for i in range(n)]


def run(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], f"vec_id long, label int, embedding {kind}, component int, vec string")
    return vectors.near_duplicates(df.repartition(3)).collect()


def key(i, n, c):
    return (i is None, i or 0, n, c is None, c or 0)


@pytest.mark.parametrize("tile_rows", [16, 1024])
def test_clusters_copies_and_labels(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(vectors, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(20):
            v = (centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.15])).astype(np.float32).tolist()
            rows += [(len(rows) + k, int(rng.integers(0, 3)), v) for k in range(int(rng.integers(1, 3)))]
    want = expected(rows)
    assert len({c for _, c in want}) < len(rows) and max(n for n, _ in want) > 3
    got = run(spark, rows)
    assert sorted(key(r.id, r.n_links, r.component) for r in got) == sorted(key(r[0], *w) for r, w in zip(rows, want, strict=True))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [2.0, 4.0]), (2, 1, [2.0, 4.0]), (3, None, [1.0, 2.0]), (4, 1, [0.0, 0.0]), (5, 1, None),
            (6, 1, []), (7, 1, [nan, 1.0]), (8, 1, [inf, 1.0]), (9, 1, [None, 1.0]), (10, 1, [1.0, 2.0, 0.0]), (None, 1, [1.0, 2.0]),
            (11, 2, [1.0, 2.0]), (None, 2, [-1.0, 5.0]), (12, 1, [1e200, 2e200]), (13, 1, [1e-200, 2e-200])]
    got = run(spark, rows, "array<double>")
    want = expected(rows)
    assert sorted(key(r.id, r.n_links, r.component) for r in got) == sorted(key(r[0], *w) for r, w in zip(rows, want, strict=True))


def test_empty_and_unusable_tables(spark):
    assert run(spark, []) == []
    assert [(r.id, r.n_links, r.component) for r in run(spark, [(3, 1, None)])] == [(3, 0, 3)]


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5, 16))
    a, b = (base[rng.integers(0, 5, 300)] + rng.normal(size=(300, 16)) * 0.12 for _ in range(2))
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    got = {(i, j) for x, y in vectors.compare_tiles(a, b, axes, 0.98, False) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    cos = vectors._unit(a) @ vectors._unit(b).T
    assert got == set(map(tuple, np.argwhere(cos >= 0.98).tolist())) and got


def test_wide_and_mixed_lengths(spark, monkeypatch):
    """Lengths below, at and beyond the rotated components; 4096 components cost no matrix of that size."""
    rng = np.random.default_rng(11)
    rows = []
    for d in (3, 31, 32, 33, 200, 4096):
        base = rng.normal(size=(3, d))
        for _ in range(24):
            v = base[rng.integers(0, 3)] + rng.normal(size=d) * 0.12
            if d > 100:  # all that differs lies beyond the axes
                v[:32] = base[0][:32]
            rows.append((len(rows), 1, v.astype(np.float32).tolist()))
    want = expected(rows)
    assert sum(n > 0 for n, _ in want) > 40
    for axes in (32, vectors.AXES):
        monkeypatch.setattr(vectors, "AXES", axes)
        got = run(spark, rows)
        assert sorted(key(r.id, r.n_links, r.component) for r in got) == sorted(key(r[0], *w) for r, w in zip(rows, want, strict=True))


def test_many_groups_of_one_label(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    monkeypatch.setattr(vectors, "GROUP_TILES", 2)
    rng = np.random.default_rng(13)
    base = rng.normal(size=(4, 12))
    rows = [(i, 1, (base[i % 4] + rng.normal(size=12) * 0.1).tolist()) for i in range(400)]
    want = expected(rows)
    got = run(spark, rows, "array<double>")
    assert sorted(key(r.id, r.n_links, r.component) for r in got) == sorted(key(r[0], *w) for r, w in zip(rows, want, strict=True))
    assert max(n for n, _ in want) > 20
