"""Per-source aggregates over parsed entries.

Everything keyed by ``source`` only (overview counts, keyword signals) is one
``groupBy('source').agg(...)`` whose partial aggregation makes each task's
output tiny, however hot a source is.  Group-bys on ``(source, value)`` use
the same partial aggregation; top-k selections are rank-then-filter windows,
which Spark executes with a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions import patterns as P
from logfold.functions.extract import iso_text
from logfold.operators.rules import KINDS, RuleSet

STAT_DIMENSIONS = (("components", "component"), ("request_ids", "request_id"), ("thread_names", "thread_name"))


def _truthy(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


#: Kinds whose rules are flags of a source; lifecycle rules select lines.
SIGNAL_KINDS = tuple(k for k in KINDS if k != "lifecycle")


def source_summary(entries: DataFrame, rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """One row per source: counts, time range, levels and every keyword signal.

    Columns: total_lines, min_ts, max_ts, time_range, levels (sorted array),
    error_events (level exactly ERROR), warning_events, error_total (ERROR,
    CRITICAL, FATAL), warning_total, and rule_masks, the bits of the keyword
    rules that hold for any message (see :mod:`logfold.operators.rules`;
    ``rules`` defaults to the built-in ones).
    """
    level = F.col("level")
    masks = RuleSet.of(rules).masks(F.col("_low"), SIGNAL_KINDS)
    rows = entries.select("source", "timestamp", "level", F.lower("message").alias("_low"))
    rows = rows.select("source", "timestamp", "level", *[m.alias(f"_mask{i}") for i, m in enumerate(masks)])
    agg = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.array_sort(F.collect_set(_truthy("level"))).alias("levels"),
        F.count_if(level == "ERROR").alias("error_events"),
        F.count_if(level == "WARNING").alias("warning_events"),
        F.count_if(level.isin(*P.ERROR_LEVELS)).alias("error_total"),
        F.count_if(level == P.WARNING_LEVEL).alias("warning_total"),
        F.array(*[F.bit_or(f"_mask{i}") for i in range(len(masks))]).cast("array<bigint>").alias("rule_masks"),
    )
    return agg.withColumn(
        "time_range",
        F.when(F.col("min_ts").isNotNull(),
               F.concat(iso_text(F.col("min_ts")), F.lit(" -> "), iso_text(F.col("max_ts")))),
    )


def first_values(entries: DataFrame, limit: int = P.FIRST_VALUES_LIMIT) -> DataFrame:
    """First ``limit`` distinct values in code-point order per source and dimension.

    ``(source, dimension, value, rank)`` with dimension in component /
    request_id / thread_name.
    """
    long = entries.select(
        "source",
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dimension"), _truthy(d).alias("value")) for d in
            ("component", "request_id", "thread_name")
        ])).alias("kv"),
    ).select("source", "kv.dimension", "kv.value").filter(F.col("value").isNotNull())
    distinct = long.distinct()
    w = Window.partitionBy("source", "dimension").orderBy("value")
    return (
        distinct.withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("rank") <= limit)
    )


def level_counts(entries: DataFrame) -> DataFrame:
    """``(source, level, n, first_line)``: every level, first-seen order via first_line."""
    return (
        entries.filter(_truthy("level").isNotNull())
        .groupBy("source", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line"))
    )


def top_values(entries: DataFrame, limit: int = P.TOP_VALUES_LIMIT) -> DataFrame:
    """Most frequent values per source and statistics dimension, ties by first seen.

    ``(source, dimension, value, n, first_line, rank)``; dimension names are
    the statistics keys components / request_ids / thread_names.
    """
    long = entries.select(
        "source", "line_number",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("dimension"), _truthy(col).alias("value"))
            for name, col in STAT_DIMENSIONS
        ])).alias("kv"),
    ).select("source", "line_number", "kv.dimension", "kv.value").filter(F.col("value").isNotNull())
    counted = long.groupBy("source", "dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line")
    )
    w = Window.partitionBy("source", "dimension").orderBy(F.col("n").desc(), F.col("first_line"))
    return counted.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)


def message_groups(entries: DataFrame, kinds: tuple[str, ...] = ("error", "warning"), stage: bool = False) -> DataFrame:
    """Error-level (ERROR, CRITICAL, FATAL) and warning entries grouped by exact message, ranked per source and kind.

    ``rank`` orders by count desc, ties by first appearance.  ``label`` is the
    key's first 120 characters (two keys may share a label).  Both kinds take
    one aggregation and one range sort.
    """
    kind = F.when(F.col("level").isin(*P.ERROR_LEVELS), F.lit("error")).when(F.col("level") == P.WARNING_LEVEL, F.lit("warning"))
    error = F.col("kind") == "error"
    msg = F.col("message")
    key = F.when(msg != "", msg).when(error, F.lit(P.UNKNOWN_ERROR)).otherwise(F.lit(P.UNKNOWN_WARNING))
    real = F.when(msg != "", F.col("line_number"))
    grouped = (
        entries.select("source", "message", "timestamp", "line_number", "raw", kind.alias("kind"))
        .filter(F.col("kind").isin(*kinds))
        .groupBy("source", "kind", key.alias("group_key"))
        .agg(
            F.count(F.lit(1)).alias("occurrence_count"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.min("line_number").alias("first_line"),
            F.min(real).alias("first_message_line"),
            F.min_by("raw", real).alias("first_message_raw"),
        )
    )
    out = grouped.select(
        "source", "kind", "group_key",
        F.substring("group_key", 1, P.GROUP_LABEL_CHARS).alias("label"),
        "occurrence_count",
        iso_text(F.col("first_ts")).alias("first_occurrence"),
        iso_text(F.col("last_ts")).alias("last_occurrence"),
        F.when(error, F.lit(P.ERROR_EXPLANATION)).otherwise(F.lit(P.WARNING_EXPLANATION)).alias("short_explanation"),
        "first_line", "first_message_line", "first_message_raw",
    )
    if stage:
        # The range sort samples its input before it sorts it.
        from logfold.staging import stage as write_stage

        out = write_stage(out, "groups")
    from logfold.operators.ranking import rank_by_count

    return rank_by_count(out, keys=("source", "kind"))


def error_groups(entries: DataFrame, stage: bool = False) -> DataFrame:
    """The error groups of :func:`message_groups`."""
    return message_groups(entries, ("error",), stage).drop("kind")


def warning_groups(entries: DataFrame, stage: bool = False) -> DataFrame:
    """The warning groups of :func:`message_groups`."""
    return message_groups(entries, ("warning",), stage).drop("kind")


def statistics(entries: DataFrame) -> DataFrame:
    """Statistics as one long table ``(source, dimension, value, n, rank)``.

    dimension ``levels`` holds every level (rank = first-seen order);
    components / request_ids / thread_names hold the top ten by count.
    """
    lv = level_counts(entries)
    w = Window.partitionBy("source").orderBy("first_line")
    levels = lv.select(
        "source", F.lit("levels").alias("dimension"), F.col("level").alias("value"), "n",
        F.row_number().over(w).cast("bigint").alias("rank"),
    )
    top = top_values(entries).select("source", "dimension", "value", "n", "rank")
    return levels.unionByName(top)
