"""Line numbering and context carry-forward, both exact in file order.

A log source (one file, or one key of a table) is cut into *blocks*: a file
split for text files (``_metadata.file_block_start``), or a fixed range of an
ordering key for table-held logs.  All work happens in ONE shuffle keyed by
``(source, block)``, so a hot source is spread over many tasks:

* inside a block: ``row_number`` and ``last(..., ignorenulls)`` windows;
* across blocks: a per-block summary (row count and the last value of each
  context field) goes through a running window over the small block table
  and is joined back.  "Last non-null" is associative, so the two-level
  result equals a single pass over the whole source.

Continuation rows (stack frames, exception lines) take level, request id,
thread, logger and trace id from the latest earlier non-continuation row that
had each of them; each field is carried independently and never reset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions.patterns import KNOWN_LEVELS
from logfold.staging import maybe_stage

CONTEXT_FIELDS = ("level", "request_id", "thread_name", "logger", "trace_id")


def _provider(f: str) -> F.Column:
    provides = ~F.col("entry_type").isin("blank", "exception", "stack_trace")
    value = F.col(f)
    ok = value.isin(*KNOWN_LEVELS) if f == "level" else (value.isNotNull() & (value != ""))
    return F.when(provides & ok, value)


def sequence_entries(parsed: DataFrame, order: list[str], keep_blank: bool = False,
                     stage_parsed: bool = True) -> DataFrame:
    """Number lines and carry context within each ``source``.

    ``parsed`` needs ``source``, ``block`` (sortable, increasing along the
    source), the ``order`` columns (increasing within a block) and the parsed
    fields from :func:`logfold.operators.parse.parse_lines`.  Returns the
    entries with ``line_number`` (1-based, blank lines counted) and
    continuation rows filled; blank rows are dropped unless ``keep_blank``.

    With ``stage_parsed`` (default) the parsed rows are first written once to
    the checkpoint folder, so the regex parse runs once although both the
    row window and the block summary read the rows (the summary reads only
    the six small columns it needs).
    """
    parsed = maybe_stage(parsed, stage_parsed, "parsed")
    # A NULL source is a group like any other: the struct around it is not null, so it joins.
    parsed = parsed.withColumn("_src", F.struct("source"))
    keys = ["_src", "block"]
    shuffled = parsed.repartition(*keys)
    prov = {f: _provider(f) for f in CONTEXT_FIELDS}
    seq = F.struct(*[F.col(c) for c in order])

    w_rows = Window.partitionBy(*keys).orderBy(*order)
    w_before = w_rows.rowsBetween(Window.unboundedPreceding, -1)
    windowed = shuffled.select(
        "*",
        F.row_number().over(w_rows).alias("_idx"),
        *[F.last(prov[f], ignorenulls=True).over(w_before).alias(f"_in_{f}") for f in CONTEXT_FIELDS],
    )

    # The block summary is aggregated from the unshuffled rows: partial
    # aggregation leaves one small row per block and task for the shuffle.
    blocks = parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(prov[f], F.when(prov[f].isNotNull(), seq)).alias(f"_last_{f}") for f in CONTEXT_FIELDS],
    )
    w_blocks = Window.partitionBy("_src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entering = blocks.select(
        *keys,
        F.coalesce(F.sum("_n").over(w_blocks), F.lit(0)).alias("_offset"),
        *[F.last(f"_last_{f}", ignorenulls=True).over(w_blocks).alias(f"_enter_{f}") for f in CONTEXT_FIELDS],
    )

    joined = windowed.join(entering, keys, "left")
    cont = F.col("entry_type").isin("exception", "stack_trace")
    filled = {
        f: F.when(cont, F.coalesce(F.col(f"_in_{f}"), F.col(f"_enter_{f}"))).otherwise(F.col(f))
        for f in CONTEXT_FIELDS
    }
    helper = {"_idx", "_offset", "_src"} | {f"_in_{f}" for f in CONTEXT_FIELDS} | {f"_enter_{f}" for f in CONTEXT_FIELDS}
    cols = []
    for c in windowed.columns:
        if c in helper:
            continue
        cols.append(filled[c].alias(c) if c in filled else F.col(c))
    out = joined.select(*cols, (F.col("_offset") + F.col("_idx")).cast("bigint").alias("line_number"))
    if not keep_blank:
        out = out.filter(F.col("entry_type") != "blank")
    return out
