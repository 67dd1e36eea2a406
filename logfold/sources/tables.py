"""Logs held in tables: a text column per source, or one line per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.patterns import ALL_LINE_SEPARATORS
from logfold.operators.context import sequence_entries
from logfold.operators.parse import parse_lines

# Lines per block for table-held logs (a hot source is spread over blocks).
BLOCK_LINES = 1 << 20


def split_text_lines(df: DataFrame, source: Column | str, text: Column | str) -> DataFrame:
    """One row per line of a text column: ``(source, line_number, raw_line)``.

    Splits like ``str.splitlines`` (``\\r\\n``, ``\\n``, ``\\r``, VT, FF, FS, GS,
    RS, NEL, LS, PS); empty pieces are kept because they count as lines.
    """
    src = F.col(source) if isinstance(source, str) else source
    txt = F.col(text) if isinstance(text, str) else text
    return df.select(
        src.cast("string").alias("source"),
        F.posexplode(F.split(F.coalesce(txt, F.lit("")), ALL_LINE_SEPARATORS, -1)).alias("pos", "raw_line"),
    ).select("source", (F.col("pos") + 1).cast("bigint").alias("line_number"), "raw_line")


def entries_from_lines(lines: DataFrame, order: str = "line_number") -> DataFrame:
    """Parse rows ``(source, <order>, raw_line)`` where ``order`` gives file order.

    Line numbers are rebuilt as 1..n by ``order`` within each source (blank
    lines counted).  ``line_number`` is taken to be dense, so its blocks are
    fixed ranges of it.  Any other key (event ids, microseconds) may be sparse
    or uneven: its blocks are the partitions of a range sort by (source, key),
    which hold about as many lines each whatever the key looks like.  The key
    must be unique within a source; lines with equal keys stay in one block, in
    any order.
    """
    if order != "line_number":
        # Written once by sequence_entries, so the partition numbers are those of one sort.
        n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = lines.repartitionByRange(n, "source", order).withColumn("block", F.spark_partition_id().cast("bigint"))
        return sequence_entries(parse_lines(ranged), order=[order])
    dense = lines.withColumn("block", F.floor(F.col(order) / F.lit(BLOCK_LINES)).cast("bigint"))
    parsed = parse_lines(dense.withColumnRenamed("line_number", "_given_line"))
    return sequence_entries(parsed, order=["_given_line"]).drop("_given_line")


def entries_from_text_column(df: DataFrame, source: Column | str, text: Column | str) -> DataFrame:
    """Entries of documents held in a table: one source per row, lines split from ``text``."""
    return entries_from_lines(split_text_lines(df, source, text))
