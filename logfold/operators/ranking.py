"""File-order top-k selections per source (timeline, head/tail, first lines).

All of them are ``row_number()`` over ``(source, ...)`` followed by a filter
on the rank, so Spark plans a partial ``WindowGroupLimit`` in every map task
and only ``k`` rows per source and task reach the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions import patterns as P
from logfold.functions.extract import iso_text
from logfold.staging import stage


def first_rows(df: DataFrame, k: int, order: list[Column], partition: tuple[str, ...] = ("source",)) -> DataFrame:
    """The first ``k`` rows per partition in ``order``, with a ``rank`` column (BIGINT)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def timeline(entries: DataFrame, limit: int = P.TIMELINE_LIMIT) -> DataFrame:
    """Warning/error entries in file order, first ``limit`` per source.

    When a source has none, its first ``limit`` entries of any level are used.
    ``(source, rank, line_number, timestamp, message, level)``; ``timestamp``
    is ISO text, ``message`` cut to 200 characters.
    """
    notable = F.coalesce(F.col("level").isin(*P.TIMELINE_LEVELS), F.lit(False)).cast("int")
    ranked = first_rows(
        entries.select("source", "line_number", "timestamp", "message", "level", notable.alias("_notable")),
        limit,
        [F.col("_notable").desc(), F.col("line_number")],
    )
    best = F.max("_notable").over(Window.partitionBy("source"))
    return (
        ranked.withColumn("_best", best)
        .filter(F.col("_notable") == F.col("_best"))
        .select(
            "source", "rank", "line_number",
            iso_text(F.col("timestamp")).alias("timestamp"),
            F.substring("message", 1, P.TIMELINE_MESSAGE_CHARS).alias("message"),
            "level",
        )
    )


def rank_by_count(groups: DataFrame, count: str = "occurrence_count", tie: str = "first_line",
                  keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by count desc, tie)``
    without sorting a whole source in one task.

    ``tie`` must be unique within ``keys`` (a first line number is).  The groups
    are range-sorted once by (keys, count descending, tie) and stored in that
    order; a group's rank is its place in its partition plus the groups with
    its keys in earlier partitions.  Even a source holding a third of all groups,
    most of them with the same count, is spread over bounded tasks; the offsets
    are one row per key and partition.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col(count).desc(), F.col(tie)]
    ordered = groups.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # A NULL key is a key like any other: the struct around it is not null, so it joins.
    ordered = stage(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
                    .withColumn("_keys", F.struct(*keys)), "ranked")
    spans = ordered.groupBy("_keys", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_keys").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_keys", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return ordered.join(spans, ["_keys", "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop(
        "_keys", "_part", "_at", "_shift")
