"""Connected components over an edge table, by min-neighbour contraction.

Each round every node points to its smallest neighbour (or itself), pointers
are followed to their roots, and the edges are rewritten between roots; the
rounds end when no edge is left.  All of it is grouping and equi-joins on long
keys: a node with very many neighbours is combined map-side in the grouping
and split by the adaptive skew join in the rewriting.  Tables between steps
are written to the checkpoint folder, so lost executors re-read them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.staging import stage


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce edges (u, v) held by one task to (node, smallest node it reaches); linear in the nodes."""
    if u.size == 0:
        return u, v
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: u.size], inv[u.size:]
    low = np.arange(nodes.size)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if np.array_equal(low, before):
            break
    keep = low != np.arange(nodes.size)
    return nodes[keep], nodes[low[keep]]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Rows with a null end and loops are ignored; repeated edges count once.
    """
    links = stage(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "cc-links",
    )
    mapping = None
    while not links.isEmpty():
        both = links.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionAll(
            links.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        parent = stage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "cc-parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stage(
                parent.join(up, "root").select("node", F.col("next").alias("root"),
                                               (F.col("next") != F.col("root")).alias("moved")),
                "cc-jump")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if mapping is None:
            mapping = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = stage(
                mapping.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")),
                "cc-map")
        lo = parent.select(F.col("node").alias("lo"), F.col("root").alias("x"))
        hi = parent.select(F.col("node").alias("hi"), F.col("root").alias("y"))
        links = stage(
            links.join(lo, "lo").join(hi, "hi").where("x != y")
            .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(),
            "cc-links")
    if mapping is None:
        return links.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return mapping
