"""Representative error lines ("interesting snippets") per source.

1. For each of the three largest error groups, the raw text of the first
   error-level entry whose message starts with the group label's first 40
   characters (duplicates kept).
2. Then further error-level raw lines in file order that are not yet listed,
   until five lines are listed.

Step 1 runs on the error-group table (one row per distinct message), not on
the entries: a group's first line and raw text were kept by the group-by, so
the prefix test is a join of at most three labels per source against that
source's groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions import patterns as P
from logfold.operators.aggregates import error_groups
from logfold.operators.joins import join_keys
from logfold.operators.ranking import first_rows

# Lines per block when short labels are matched with the groups of a source.
SNIPPET_BLOCK = 1 << 20


def snippets(entries: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(source, rank, raw)`` with at most five rows per source."""
    if groups is None:
        # Read twice below (labels and candidates): staged once.
        from logfold.staging import stage

        groups = stage(error_groups(entries, stage=True), "error_groups")
    eg = groups
    top = eg.filter(F.col("rank") <= P.SNIPPET_GROUPS).select(
        "source", F.col("rank").alias("g_rank"),
        F.substring("label", 1, P.SNIPPET_PREFIX_CHARS).alias("prefix"),
    )
    cand = eg.filter(F.col("first_message_line").isNotNull()).select(
        F.col("source").alias("c_source"), "group_key", "first_message_line", "first_message_raw",
    )
    # A full 40-character prefix matches exactly the groups whose first 40
    # characters equal it: an equi-join on (source, prefix), spread over the
    # distinct prefixes of a hot source.  A shorter label is a whole message,
    # matched by a prefix test.  Its source's groups are cut into blocks of
    # first lines, and the (at most three) labels are handed to each block
    # that exists, so this too is an equi-join with bounded tasks.
    n = P.SNIPPET_PREFIX_CHARS
    long_top = top.filter(F.length("prefix") == n)
    short_top = top.filter(F.length("prefix") < n)
    long_cand = cand.filter(F.length("group_key") >= n).withColumn("_k", F.substring("group_key", 1, n))
    long_match = long_cand.join(
        long_top, long_top["source"].eqNullSafe(long_cand["c_source"]) & (long_top["prefix"] == long_cand["_k"]))
    cand = cand.withColumn("c_block", F.floor(F.col("first_message_line") / F.lit(SNIPPET_BLOCK)))
    blocks = cand.select(F.col("c_source").alias("b_source"), F.col("c_block").alias("b_block")).distinct()
    short_top = short_top.join(blocks, F.col("source").eqNullSafe(F.col("b_source")))
    short_match = cand.join(
        short_top, short_top["source"].eqNullSafe(cand["c_source"]) & (short_top["b_block"] == cand["c_block"])
        & cand["group_key"].startswith(short_top["prefix"]))
    cols = ["source", "g_rank", "first_message_line", "first_message_raw"]
    matched = (
        long_match.select(*cols).unionByName(short_match.select(*cols))
        .groupBy("source", "g_rank")
        .agg(F.min_by("first_message_raw", "first_message_line").alias("raw"))
    )
    # Distinct error raws in file order; at most 3 of them can be excluded, so
    # the first 8 per source suffice.
    err_raw = (
        entries.filter(F.col("level").isin(*P.ERROR_LEVELS))
        .groupBy("source", "raw").agg(F.min("line_number").alias("first_line"))
    )
    head = first_rows(err_raw, P.SNIPPET_LIMIT + P.SNIPPET_GROUPS, [F.col("first_line")])
    rest = join_keys(head, matched.select("source", "raw"), ["source", "raw"], "left_anti")

    both = matched.select(
        "source", F.lit(0).alias("part"), F.col("g_rank").cast("bigint").alias("pos"), "raw"
    ).unionByName(
        rest.select("source", F.lit(1).alias("part"), F.col("first_line").cast("bigint").alias("pos"), "raw")
    )
    w = Window.partitionBy("source").orderBy("part", "pos")
    ranked = both.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= P.SNIPPET_LIMIT).select("source", "rank", "raw")
