"""SimHash near-duplicates with BK-trees over shards of fingerprints.

``fingerprints`` hashes every word shingle of a whole text with XXH64 (the
Arrow pass keeps 64 counters per document, whatever its length).  ``links``
finds all pairs of distinct fingerprints within a radius:

* The 64 bits are cut into radius + 2 blocks.  Two fingerprints within the
  radius agree on at least two blocks, so each fingerprint goes to one shard
  per pair of blocks, keyed by the bits of these blocks (about 21 bits at
  radius 4: a shard holds a few hundred of a billion random fingerprints).
* Each shard builds a BK-tree (children keyed by the integer distance to
  their parent) and its members follow only edges within the radius.
* A shard beyond ``max_tree`` members is dealt into trees of about that size;
  each tree is sent to every query block of its shard, so no tree, and no
  task's group, grows with the data.  This is the broadcast of shard trees,
  confined to the queries that can reach them: one driver-side broadcast of
  all trees would grow with the corpus.

Exact copies share a fingerprint and are one node; a task reduces the pairs it
finds to a spanning star, so output is linear in the shard members.

Defined results: null and empty texts, and texts without a word, have
fingerprint zero and link like any other; a null id stays null and its
component is the smallest non-null id of the group (null if there is none);
repeated rows stay separate rows with one component.  Only the id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.graphs import connected_components, star_edges
from logfold.llm.workers import tidy
from logfold.staging import stage

SHINGLE_WORDS = 4
RADIUS = 4
MAX_TREE = 1024
#: Rows and (query, node) pairs a task holds at a time.
BUFFER_ROWS = 200_000
FRONTIER = 1_000_000


def simhash(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of UTF-8 text; A-Z fold, words end at ASCII white space."""
    import xxhash

    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n < shingle_words:
        return int.from_bytes(digest(joined, 42), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = n - shingle_words + 1
    starts, ends = starts[:total], ends[shingle_words - 1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, total, 16384):
        raw = b"".join([digest(joined[s:e], 42) for s, e in
                        zip(starts[i:i + 16384].tolist(), ends[i:i + 16384].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def _hash_column(col: pa.Array, shingle_words: int) -> pa.Array:
    out = np.zeros(len(col), np.int64)
    for i in range(len(col)):
        x = col[i]
        if x.is_valid:
            out[i] = simhash(x.as_buffer().to_pybytes(), shingle_words)
    return pa.array(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the signed 64-bit fingerprint."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _hash_column(b.column(1), shingle_words)], ["id", "fp"])

    return src.mapInArrow(tidy(run), "id long, fp long")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc struct of all columns, fp): every row of ``docs`` kept whole beside its fingerprint."""
    src = docs.select(F.struct("*").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _hash_column(b.column(1), shingle_words)], ["doc", "fp"])

    return src.mapInArrow(tidy(run), schema)


def shard_masks(radius: int) -> list[int]:
    """Signed masks of every pair of radius + 2 nearly equal blocks of 64 bits."""
    n = radius + 2
    bounds = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


class BKForest:
    """BK-trees of many shards at once: children keyed by integer Hamming distance to the parent."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """fps: distinct values within a shard; shard: non-decreasing shard number of each."""
        self.fps = fps
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if fps.size else np.zeros(0, int)
        self.root = dict(zip(shard[first].tolist(), first.tolist(), strict=True))
        at = np.repeat(first, np.diff(np.append(first, fps.size)))
        todo = np.setdiff1d(np.arange(fps.size), first, assume_unique=True)
        at = at[todo]
        edges, children = [], []
        while todo.size:
            key = at * 65 + np.bitwise_count(fps[todo] ^ fps[at]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, todo = key[order], todo[order]
            lead = np.concatenate([[True], key[1:] != key[:-1]])
            edges.append(key[lead])
            children.append(todo[lead])
            at = np.repeat(todo[lead], np.diff(np.append(np.flatnonzero(lead), key.size)))[~lead]
            todo = todo[~lead]
        key = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, node) of every member within the radius of its query."""
        q, node, hits = np.arange(queries.size), roots, []
        while q.size:
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            hits.append((q[near], node[near]))
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - lo
            q = np.repeat(q, n)
            step = np.arange(q.size) - np.repeat(np.cumsum(n) - n, n)
            node = self.child[np.repeat(lo, n) + step]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in hits]), np.concatenate([y for _, y in hits])


def _link_groups(fps: np.ndarray, group: np.ndarray, tree: np.ndarray, probe: np.ndarray,
                 radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of all links between tree members and probes of the same group."""
    u = fps.view(np.uint64)
    ti = np.flatnonzero(tree)
    forest = BKForest(u[ti], group[ti])
    qi = np.flatnonzero(probe)
    roots = np.array([forest.root.get(g, -1) for g in group[qi].tolist()], np.int64)
    qi, roots = qi[roots >= 0], roots[roots >= 0]
    if not qi.size:
        return fps[:0], fps[:0]
    size = np.bincount(group[ti], minlength=int(group.max()) + 1)[group[qi]]
    cut = np.cumsum(size) // FRONTIER
    a, b = fps[:0], fps[:0]
    for part in np.split(np.arange(qi.size), np.flatnonzero(np.diff(cut)) + 1):
        q, node = forest.search(u[qi[part]], roots[part], radius)
        x, y = fps[qi[part]][q], fps[ti][node]
        diff = x != y
        a, b = star_edges(np.concatenate([a, x[diff]]), np.concatenate([b, y[diff]]))
    return a, b


def links(classes: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints ``classes.fp`` within ``radius`` bits.

    Every pair within the radius is joined by a path of these edges, and every
    edge lies within a group of such pairs.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in shard_masks(radius)])
    keyed = classes.select("fp", F.posexplode(masks).alias("band", "mask")).select(
        F.col("band").cast("short").alias("band"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
    hot = stage(
        keyed.groupBy("band", "bits").agg(F.count("*").alias("members")).where(F.col("members") > max_tree)
        .select("band", "bits", F.ceil(F.col("members") / max_tree).cast("int").alias("trees")),
        "simhash-hot")
    trees = F.coalesce("trees", F.lit(1))
    dealt = keyed.join(hot, ["band", "bits"], "left").select(
        "band", "bits", "fp", trees.alias("trees"), F.pmod(F.xxhash64("fp"), trees).cast("int").alias("own"))
    rows = dealt.select("band", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("x")).select(
        "band", "bits", F.least("own", "x").alias("tree"), F.greatest("own", "x").alias("block"), "own", "fp")
    key = ["band", "bits", "tree", "block"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush(last: bool) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held, count
            rows = np.concatenate(held, axis=1)
            change = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            end = rows.shape[1] if last else (change[-1] if change.size else 0)
            held, count = [rows[:, end:]], rows.shape[1] - end
            rows = rows[:, :end]
            if not end:
                return rows[5], rows[5]
            group = np.zeros(end, np.int64)
            group[change[change < end]] = 1
            group = np.cumsum(group)
            some = np.bincount(group)[group] > 1
            rows, group = rows[:, some], group[some]
            if not group.size:
                return rows[5], rows[5]
            tree, block, own, fps = rows[2], rows[3], rows[4], rows[5]
            return _link_groups(fps, group, own == tree, own == block, radius)

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]))
            count += b.num_rows
            if count >= BUFFER_ROWS:
                u, v = flush(False)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])
        if held:
            u, v = flush(True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return rows.select(*key, "own", "fp").mapInArrow(tidy(run), "a long, b long")


def _keepers(staged: DataFrame, order: Column, radius: int, max_tree: int) -> DataFrame:
    """(fp, best): the smallest ``order`` of each fingerprint's component."""
    classes = stage(staged.groupBy("fp").agg(F.min(order).alias("best")), "simhash-classes")
    roots = connected_components(links(classes, radius, max_tree))
    rooted = stage(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "best"), "simhash-roots")
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select("fp", "root").join(best, "root").select("fp", "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; component is the smallest id reachable."""
    staged = stage(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fps")
    best = _keepers(staged, F.col("id"), radius, max_tree)
    return staged.join(best, "fp", "left").select("id", "fp", F.col("best").alias("component"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (nulls last, then any one row)."""
    marked = stage(with_fingerprint(docs, text_col, shingle_words)
                   .withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
    ident = F.col("doc").getField(id_col)
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("row").alias("row"))
    best = _keepers(marked, order, radius, max_tree).select(F.col("best.row").alias("row")).distinct()
    kept = marked.join(best, "row", "left_semi")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
