"""Embedding near-duplicates: PCA-ordered tiled comparison.

1. Rows with the same label and the same vector are one class (its row count
   is kept as a weight), so copies are never compared with each other.
2. The second-moment matrix of all class vectors (unit length) gives the
   principal axes, over at most the first ``AXES`` components: a task sums one
   matrix, a second pass adds up the tasks', so a long vector costs no more.
   Rotation keeps inner products; the leading coordinates carry most of them.
3. Classes are range-sorted by label, the bins of the first two coordinates
   and the third coordinate, and cut into tiles of bounded bytes.  A tile
   keeps the bounding box of its leading coordinates and suffix norms.
4. Unit vectors with cosine >= t lie within sqrt(2 - 2t), so only tiles of the
   same label in neighbouring bins of the first coordinate, whose boxes are
   that near, are paired.
5. Tiles that follow one another form groups of up to ``GROUP_TILES``.  A tile
   is sent once to each pair of groups in which it has a partner, in the input's
   own precision, not once to each partner.
6. Two tiles are compared by accumulating the leading coordinates first,
   bounding the rest of each product by the product of suffix norms (components
   beyond the axes included), and stopping for all pairs that cannot reach the
   threshold.  Pairs that survive are decided by the cosine of the original
   vectors in double precision.  Link counts and a spanning star leave a task,
   never the pairs.

Defined results: a vector that is null, empty or zero, or that holds a null or
non-finite component, and every vector with a null label, links with nothing
(no links, its own component).  Vectors of different lengths do not link.
Very long vectors are compared whole.  Cosines at the threshold link.
Repeated rows are separate rows and link with each other; an empty table gives
no rows.  A null id stays
null; a component's id is its smallest non-null id.  Only the id, label and
vector columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.graphs import connected_components, star_edges
from logfold.staging import stage

THRESHOLD = 0.98
TILE_ROWS = 1024
TILE_BYTES = 2 << 20
BOX_DIMS = 8
#: Leading components that the axes rotate, and tiles of a group.
AXES = 256
GROUP_TILES = 8
#: Slack of the bounds for rounding; survivors are decided exactly.
EPS = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by the largest component, so squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """dim x dim rotation of the first ``dim`` components: eigenvectors of their second moment, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            flat = _matrix(b.column(0))
            off = np.concatenate([[0], np.cumsum(np.diff(b.column(0).offsets.to_numpy()))])
            sizes = np.diff(off)
            for d in np.unique(sizes):
                at = off[:-1][sizes == d]
                x = _unit(flat[at[:, None] + np.arange(d)])[:, :dim]
                total[:x.shape[1], :x.shape[1]] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moment"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moment"])

    # One matrix a task, then one for each of 16 partitions: a bounded number of bounded rows reaches the driver.
    moments = classes.select("vec").mapInArrow(run, "moment binary").repartition(16).mapInArrow(add, "moment binary")
    total = sum((np.frombuffer(r.moment) for r in moments.collect()), np.zeros(dim * dim))
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1]


def _prefixes(dim: int) -> list[int]:
    """Numbers of leading coordinates after which the bound is tested: 4, 8, 16, ... dim."""
    out, k = [], 4
    while k < dim:
        out.append(k)
        k *= 2
    return [*out, dim]


class Tile:
    """Unit rows of a tile, their rotated components and the norms of what follows each prefix of them."""

    def __init__(self, rows: np.ndarray, axes: np.ndarray):
        self.unit = _unit(rows)
        head = self.unit[:, :len(axes)]
        self.rotated = head @ axes[:head.shape[1]]
        beyond = (self.unit[:, len(axes):] ** 2).sum(axis=1)
        self.cuts = _prefixes(self.rotated.shape[1])
        self.tails = [np.sqrt((self.rotated[:, k:] ** 2).sum(axis=1) + beyond) for k in self.cuts]

    def links(self, other: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i, j) with cosine >= threshold (i < j for the tile itself), in blocks of its rows."""
        same, ra, rb = other is self, self.rotated, other.rotated
        for lo in range(0, len(ra), 256):
            block = ra[lo:lo + 256]
            dots = np.zeros((len(block), len(rb)))
            i = j = None
            start = 0
            for k, sa, sb in zip(self.cuts, self.tails, other.tails, strict=True):
                if i is None:
                    dots += block[:, start:k] @ rb[:, start:k].T
                    alive = dots + sa[lo:lo + 256, None] * sb[None, :] >= threshold - EPS
                    if same:
                        alive &= np.arange(lo, lo + len(block))[:, None] < np.arange(len(rb))[None, :]
                    if alive.sum() * 8 < alive.size:  # few are left: go on pair by pair
                        i, j = np.nonzero(alive)
                        dots = dots[i, j]
                else:
                    dots = dots + np.einsum("ij,ij->i", block[i, start:k], rb[j, start:k])
                    keep = dots + sa[lo + i] * sb[j] >= threshold - EPS
                    i, j, dots = i[keep], j[keep], dots[keep]
                start = k
                if i is not None and not i.size:
                    break
            if i is None:
                i, j = np.nonzero(alive)
            step = max(256, (64 << 20) // (8 * self.unit.shape[1]))
            hits = [np.einsum("ij,ij->i", self.unit[lo + i[s:s + step]], other.unit[j[s:s + step]]) >= threshold
                    for s in range(0, i.size, step)]
            ok = np.concatenate(hits) if hits else np.zeros(0, bool)
            yield lo + i[ok], j[ok]


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float,
                  same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``Tile.links`` of two matrices; ``same``: of ``a`` with itself."""
    first = Tile(a, axes)
    return first.links(first if same else Tile(b, axes), threshold)


def _tiles(classes: DataFrame, axes: np.ndarray, width: float, element: str) -> DataFrame:
    """Bounded tiles of PCA-ordered classes, with their boxes; a tile's number without its last 4 bits is its group's."""
    box = min(BOX_DIMS, axes.shape[1])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = b.column(2).offsets.to_numpy()
            flat, sizes = _matrix(b.column(2)), np.diff(off)
            start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            pcs = np.zeros((b.num_rows, 3))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                r = _unit(flat[start[at][:, None] + np.arange(d)])[:, :len(axes)] @ axes[:d, :3]
                pcs[at, :r.shape[1]] = r
            bins = np.floor(pcs[:, :2] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sizes.astype(np.int32)), pa.array(bins[:, 0]), pa.array(bins[:, 1]),
                 pa.array(pcs[:, 2])], ["id", "label", "vec", "weight", "dim", "b1", "b2", "p3"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("id", "label", "vec", "weight").mapInArrow(
        lead, f"id long, label {kind}, vec array<double>, weight long, dim int, b1 int, b2 int, p3 double")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "dim", "b1", "b2", "p3", "id"]
    placed = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, group, seq, of = TaskContext.get().partitionId(), 0, 0, None
        held: list[tuple] = []

        def tile() -> pa.RecordBatch:
            nonlocal held, group, seq, of
            if seq == GROUP_TILES or of != held[0][:2]:  # a group's tiles have one label and length
                group, seq, of = group + 1, 0, held[0][:2]
            ids, vecs, weights = ([x[k] for x in held] for k in (2, 3, 4))
            m = np.array(vecs)
            r = _unit(m)[:, :len(axes)] @ axes[:m.shape[1]]
            top = r[:, :box]
            rest = np.sqrt(np.maximum(0, 1 - (top * top).sum(axis=1)))
            top = np.column_stack([top, rest])
            out = pa.RecordBatch.from_pylist([{
                "tile": (part << 40) + (group << 4) + seq, "label": held[0][0], "dim": held[0][1],
                "b_lo": int(np.floor(r[:, 0].min() / width)), "b_hi": int(np.floor(r[:, 0].max() / width)),
                "lo": top.min(axis=0).tolist(), "hi": top.max(axis=0).tolist(),
                "ids": np.array(ids, np.int64).tobytes(), "weights": np.array(weights, np.int64).tobytes(),
                "vecs": m.astype(element).tobytes()}], schema=arrow)
            held, seq = [], seq + 1
            return out

        for b in batches:
            labels, dims = b.column(1).to_pylist(), b.column(4).to_pylist()
            ids, weights = b.column(0).to_pylist(), b.column(3).to_pylist()
            off = np.concatenate([[0], np.cumsum(dims)])
            flat = _matrix(b.column(2))
            for k in range(b.num_rows):
                if held and (held[0][0] != labels[k] or held[0][1] != dims[k]
                             or len(held) >= max(16, min(TILE_ROWS, TILE_BYTES // (8 * dims[k])))):
                    yield tile()
                held.append((labels[k], dims[k], ids[k], flat[off[k]:off[k + 1]], weights[k]))
        if held:
            yield tile()

    schema = (f"tile long, label {kind}, dim int, b_lo int, b_hi int, lo array<double>, hi array<double>, "
              "ids binary, weights binary, vecs binary")
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = pa.schema([("tile", pa.int64()), ("label", to_arrow_type(classes.schema["label"].dataType)),
                       ("dim", pa.int32()), ("b_lo", pa.int32()), ("b_hi", pa.int32()),
                       ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                       ("ids", pa.binary()), ("weights", pa.binary()), ("vecs", pa.binary())])
    return placed.select("id", "label", "vec", "weight", "dim").mapInArrow(cut, schema)


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(ga, gb, a, b) with a <= b: groups and tiles of one label whose boxes come within the reach of the threshold."""
    meta = tiles.select("tile", "label", "dim", "b_lo", "b_hi", "lo", "hi")
    left = meta.select(F.col("tile").alias("a"), "label", "dim", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"),
                       F.explode(F.sequence(F.col("b_lo") - 1, F.col("b_hi") + 1)).alias("bin"))
    right = meta.select(F.col("tile").alias("b"), "label", "dim", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"),
                        F.explode(F.sequence("b_lo", "b_hi")).alias("bin"))
    gap = F.aggregate(
        F.transform(F.arrays_zip("a_lo", "a_hi", "b_lo", "b_hi"),
                    lambda x: F.greatest(F.lit(0.0), x["a_lo"] - x["b_hi"], x["b_lo"] - x["a_hi"])),
        F.lit(0.0), lambda s, g: s + g * g)
    return (left.join(right, ["label", "dim", "bin"]).where("a <= b")
            .where(gap <= 2 - 2 * threshold + EPS)
            .select(F.shiftright("a", 4).alias("ga"), F.shiftright("b", 4).alias("gb"), "a", "b").distinct())


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component): one row per row of ``rows``."""
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                      F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite
                        & F.exists("vec", lambda x: x != 0), F.lit(False))
    src = src.withColumn("usable", usable)
    classes = stage(
        src.where("usable").groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
        .withColumn("id", F.monotonically_increasing_id()), "vectors-classes")
    dim = classes.agg(F.max(F.size("vec")).alias("d")).first().d
    if dim is None:  # no usable vector
        return src.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    axes = principal_axes(classes, min(dim, AXES))
    # Vectors of 32-bit numbers travel as such; products are always taken in double precision.
    element = "<f4" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    tiles = stage(_tiles(classes, axes, float(np.sqrt(2 - 2 * threshold)) + EPS, element), "vectors-tiles")
    pairs = stage(_tile_pairs(tiles, threshold), "vectors-pairs")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A unit of work is a pair of groups: each of its tiles once, with its partners in the unit.
    needed = pairs.select("ga", "gb", F.explode(F.array("a", "b")).alias("tile"), "a", "b").groupBy("ga", "gb", "tile").agg(
        F.collect_set(F.when(F.col("tile") == F.col("a"), F.col("b"))).alias("partners"))
    work = needed.join(tiles.select("tile", "dim", "ids", "weights", "vecs"), "tile").repartition(n, "ga", "gb")
    work = work.sortWithinPartitions("ga", "gb", "tile").select("ga", "gb", "tile", "partners", "dim", "ids", "weights", "vecs")

    def unit(held: list[tuple]) -> pa.RecordBatch:
        """Link counts and spanning stars of the tile pairs of a unit: rows (tile, partners, dim, ids, weights, vecs)."""
        tiles = {t: (Tile(np.frombuffer(v, element).astype(np.float64).reshape(-1, d), axes), np.frombuffer(i, np.int64),
                     np.frombuffer(w, np.int64)) for t, _, d, i, w, v in held}
        sums = {t: np.zeros(len(x[1]), np.int64) for t, x in tiles.items()}
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, partners, *_ in held:
            for p in partners:
                (x, ia, wa), (y, ib, wb) = tiles[t], tiles[p]
                for i, j in x.links(y, threshold):
                    np.add.at(sums[t], i, wb[j])
                    np.add.at(sums[p], j, wa[i])
                    u, v = star_edges(np.concatenate([u, ia[i]]), np.concatenate([v, ib[j]]))
        ids = np.concatenate([x[1] for x in tiles.values()])
        counts = np.concatenate(list(sums.values()))
        some = counts > 0
        ids, counts = ids[some], counts[some]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, u])),
             pa.array(np.concatenate([np.zeros_like(ids), v]), mask=np.arange(ids.size + v.size) < ids.size),
             pa.array(np.concatenate([counts, np.zeros_like(u)]))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            for k in range(b.num_rows):
                now = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                if held and now != key:
                    yield unit(held)
                    held = []
                key = now
                held.append(tuple(b.column(c)[k].as_py() for c in range(2, 8)))
        if held:
            yield unit(held)

    found = stage(work.mapInArrow(run, "a long, b long, n long"), "vectors-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null")).withColumnRenamed("node", "id")
    rooted = stage(classes.join(counts, "id", "left").join(roots, "id", "left").select(
        "label", "vec", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "id").alias("root")), "vectors-rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("component"))
    done = rooted.join(best, "root").select("label", "vec", "n_links", "component")
    linked = src.where("usable").join(done, ["label", "vec"]).select("id", "n_links", "component")
    alone = src.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionAll(alone)
