"""Evidence bundle per source: bounded, factual line lists for a model step.

Sections (all in file order unless noted): the first 150 error-level lines,
the first 150 warning lines, the first 150 lifecycle lines, and a sample of
at most 500 lines = the distinct prioritised lines (ordered by first line
number; the original leaves this order unspecified) followed by the first 50
and last 50 entries that are not prioritised (duplicates between head and
tail kept).  Every list is a rank-then-filter window, so nothing unbounded is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions import patterns as P
from logfold.functions.extract import iso_text
from logfold.operators.joins import join_keys
from logfold.operators.ranking import first_rows
from logfold.operators.rules import RuleSet


def format_line(ts: Column, level: Column, raw: Column) -> Column:
    """``[<iso timestamp or unknown>] <LEVEL or UNKNOWN> <raw>``."""
    return F.concat(
        F.lit("["), F.coalesce(iso_text(ts), F.lit("unknown")), F.lit("] "),
        F.coalesce(F.when(level != "", level), F.lit("UNKNOWN")), F.lit(" "), raw,
    )


def evidence_lines(entries: DataFrame, level_lines: int = P.EVIDENCE_LEVEL_LINES,
                   sample_lines: int = P.EVIDENCE_SAMPLE_LINES, rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """``(source, section, rank, line_number, line)`` for sections
    error_lines, warning_lines, lifecycle_lines and sample_lines.

    ``rules`` (see :mod:`logfold.operators.rules`) names the lifecycle keywords.
    """
    lifecycle = RuleSet.of(rules).holds(F.lower("message"), "lifecycle")
    base = entries.select(
        "source", "line_number", "level", "message",
        format_line(F.col("timestamp"), F.col("level"), F.col("raw")).alias("line"),
    )
    # The three level/lifecycle sections in one pass: each entry is tagged
    # with the sections it belongs to, then one rank-then-filter window per
    # (source, section) keeps the first ``level_lines`` of each.
    tags = F.array_compact(F.array(
        F.when(F.col("level").isin(*P.ERROR_LEVELS), F.lit("error_lines")),
        F.when(F.col("level") == P.WARNING_LEVEL, F.lit("warning_lines")),
        F.when(lifecycle, F.lit("lifecycle_lines")),
    ))
    tagged = base.select("source", "line_number", "line", F.explode(tags).alias("section"))
    prioritized_all = first_rows(
        tagged, level_lines, [F.col("line_number")], partition=("source", "section")
    ).select("source", "section", "rank", "line_number", "line")

    prioritized = prioritized_all.groupBy("source", "line").agg(F.min("line_number").alias("first_line"))
    n = P.EVIDENCE_HEAD_TAIL
    head = first_rows(base, n, [F.col("line_number")]).select(
        "source", "line_number", "line", F.lit(1).alias("part"), F.col("line_number").alias("pos"))
    tail = first_rows(base, n, [F.col("line_number").desc()]).select(
        "source", "line_number", "line", F.lit(2).alias("part"), F.col("line_number").alias("pos"))
    head_tail = join_keys(head.unionByName(tail), prioritized.select("source", "line"), ["source", "line"], "left_anti")
    sample = prioritized.select(
        "source", F.col("first_line").alias("line_number"), "line",
        F.lit(0).alias("part"), F.col("first_line").alias("pos"),
    ).unionByName(head_tail)
    w = Window.partitionBy("source").orderBy("part", "pos")
    sample = (
        sample.withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("rank") <= sample_lines)
        .select("source", F.lit("sample_lines").alias("section"), "rank", "line_number", "line")
    )
    return prioritized_all.unionByName(sample)
