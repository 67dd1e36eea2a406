"""SimHash: fingerprints by definition, BK-trees and components against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from brute import components

from logfold.llm import simhash


def by_definition(text: str | None, k: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def expected(ids, fps):
    u = np.array(fps, np.int64).view(np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    low = components(len(ids), pairs.tolist())
    best = {}
    for i, root in enumerate(low):
        if ids[i] is not None:
            best[root] = min(best.get(root, ids[i]), ids[i])
    return [best.get(root) for root in low]


def test_documents_by_brute_force(docs, doc_rows):
    rows = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: r.id)
    fps = [by_definition(r.text) for r in doc_rows]
    assert [r.fp for r in rows] == fps
    assert [r.component for r in rows] == expected([r.doc_id for r in doc_rows], fps)


@pytest.mark.parametrize("max_tree", [4, 1024])
def test_links_of_chains_and_dense_families(spark, max_tree):
    rnd = random.Random(5)
    fps = {0, -1}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 40])):
            fps.add(x - (1 << 64) if x >> 63 else x)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), max_tree=max_tree)
    got = components(len(fps), [(fps.index(r.a), fps.index(r.b)) for r in edges.collect()])
    u = np.array(fps, np.int64).view(np.uint64)
    assert got == components(len(fps), np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4).tolist())
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert [roots.get(f, f) for f in fps] == [fps[g] for g in got]


def test_tree_search_equals_scan():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 16, 400).astype(np.uint64))
    shard = np.sort(rng.integers(0, 5, fps.size))
    forest = simhash.BKForest(fps, shard)
    roots = np.array([forest.root[s] for s in shard.tolist()])
    q, node = forest.search(fps, roots, 3)
    got = set(zip(q.tolist(), node.tolist(), strict=True))
    want = {(i, j) for i in range(fps.size) for j in np.flatnonzero(shard == shard[i]).tolist()
            if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want


def test_odd_rows(spark):
    rows = [(3, None), (None, ""), (5, " \n"), (5, "A b"), (7, "a B"), (None, "lonely words here"), (9, "w " * 40000), (1, "e" * 100000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string")
    got = sorted((r.id is not None, r.id or 0, r.fp, r.component) for r in simhash.near_duplicates(df).collect())
    fps = [by_definition(t) for _, t in rows]
    comp = expected([i for i, _ in rows], fps)
    assert got == sorted((i is not None, i or 0, f, c) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert len(kept.collect()) == len({c if c is not None else ("none", f) for f, c in zip(fps, comp, strict=True)})
    empty = df.where("doc_id > 99")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.deduplicate(empty).collect() == []


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(4, "same words in this text")] * 3 + [(8, "same words in this text")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicate(df).collect()] == [4]
    assert [r.component for r in simhash.near_duplicates(df).collect()] == [4] * 4
