"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame expressions only.

1. Sizes: words of every whole text, summed by source.
2. Targets: the sources, in code-point order, take the weights in turn and
   share ``share`` times all words.  A target stops at ``repeats`` times its
   source's size; the excess is shared again by weight among the others until
   no target is above.  A round is one aggregation over the source table that
   brings two sums to the driver; the arithmetic is on integers, so the targets
   are exact quotients.  A source's mix is the whole words of its target.
3. Blocks: a source's documents are shuffled (ordered by SHA-256 of seed and
   id) and read as one stream of words, cut into blocks of ``block_words``; only
   the stream's last block may be shorter.  Documents are range-sorted by
   (source, hash), so a document's place is the running sum in its partition
   plus the sums of earlier partitions.
4. Schedule: with N = 2^m slots, N at least the blocks all sources need, slot k
   is the van der Corput point k with its m bits reversed; the cumulative needs
   of the sources map it to a source (or to none, the slot stays empty).  The
   points meet each unit interval once, so every source gets the slots it needs,
   evenly spread at every scale.  Points and cumulative needs meet in an
   equi-join on cells of ``CELL`` units: a source is filed under each cell it
   covers, a cell has at most ``CELL`` points and ``CELL`` sources.
5. A source's slots are ranked by k (counts of earlier slot ranges plus the
   rank in the range); rank r takes block r modulo the source's blocks, in pass
   r div blocks.  The last slot is cut where the source's mix ends.

``schedule`` gives the slots in order, ``segments`` the documents' word ranges
in them, ``taken`` the sums per document.  Everything depends on seed, ids and
sizes alone, so reruns agree.

Defined results: a null text has size 0 and is in no block; a null source is a
source of its own, the last; a null id is hashed as the empty string; rows with
equal ids are ordered by size, and rows equal in both are exchangeable; an empty
table gives no rows, and a corpus without words all zeros.  Only the id, text
and source columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.staging import stage

WEIGHTS = (3, 1, 2)
#: All sources together take SHARE[0] / SHARE[1] times all words, no source more than REPEATS times its own.
SHARE = (3, 2)
REPEATS = 2
BLOCK_WORDS = 1024
SEED = "mix"
CELL = 64
#: Slots of one range in the ranking of a source's slots.
RANGE_BITS = 14
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """Stored tables of a mix: documents placed in their source's stream, and sources with their targets."""

    documents: DataFrame  # row, doc_id, size, s, start
    sources: DataFrame    # s, source, source_size, weight, target, limit, blocks, need
    block_words: int


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Stored (row, doc_id, source, size)."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    return stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                             size.alias("size")).withColumn("row", F.monotonically_increasing_id()), "mixing-sizes")


def _numbered(table: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``table`` range-sorted by ``order``, stored with part and at (ascending in it), and the row counts of its parts."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(table.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), name)
    return ranged, ranged.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
                   repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Stored (s, source, source_size, weight, target, limit, blocks, need): one row per source, s by code point, null last."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged, parts = _numbered(totals, [F.col("source").asc_nulls_last()], "mixing-sources")
    # One row a partition: a window over so small a table is bounded.
    shift = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0)) - F.col("first")).alias("shift"))
    s = F.col("at") + F.col("shift")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (s % len(weights) + 1).cast("int"))
    ranked = stage(ranged.join(F.broadcast(shift), "part").select(s.alias("s"), "source", "source_size", weight.alias("weight")),
                   "mixing-ranked")

    # A target above its cap stops there; what is left, num / den by weight, goes to the others.
    cap = (F.col("source_size") * repeats).cast("decimal(38,0)")
    all_words = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    num, den = 0, 1
    stopped, open_weight = None, None
    while True:
        above = F.lit(stopped is not None) & (F.col("weight").cast("decimal(38,0)") * F.lit(Decimal(num)) > cap * F.lit(Decimal(den)))
        r = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        now = int(r[0] or 0), int(r[1] or 0)
        if now == (stopped, open_weight) or not now[1]:
            break
        stopped, open_weight = now
        num, den = share[0] * all_words - share[1] * stopped, share[1] * open_weight
    capped = F.col("weight").cast("decimal(38,0)") * F.lit(Decimal(num)) > cap * F.lit(Decimal(den))
    part = F.col("weight") * F.lit(num).cast("long")
    target = F.when(capped, cap.cast("double")).otherwise(part.cast("double") / F.lit(float(den)))
    limit = F.when(capped, F.col("source_size") * repeats).otherwise(F.expr(f"weight * {num}L div {den}L"))
    blocks = F.ceil(F.col("source_size") / block_words)
    left = F.col("limit") % F.greatest(F.col("source_size"), F.lit(1))
    need = F.expr("limit div greatest(source_size, 1)") * F.col("blocks") + F.ceil(left / block_words)
    return stage(ranked.withColumn("target", target).withColumn("limit", limit).withColumn("blocks", blocks)
                 .withColumn("need", need), "mixing-targets")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS,
        block_words: int = BLOCK_WORDS, seed: str = SEED) -> Mix:
    """Targets of the sources and places of the documents; see the module for the rest."""
    sized = sizes(docs, id_col, text_col, source_col)
    sources = source_targets(sized, weights, share, repeats, block_words)
    known = sources.select("s", F.col("source").alias("_source"))
    key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    # The row number splits even documents that agree in source, id and size between partitions.
    order = [F.col(c) for c in ("s", "key", "size", "row")]
    keyed = stage(sized.join(known, F.col("source").eqNullSafe(F.col("_source")))
                  .select("row", "doc_id", "size", "s", key.alias("key")), "mixing-keyed")
    ranged, _ = _numbered(keyed, order, "mixing-sorted")
    spans = ranged.groupBy("s", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("s", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier"))
    # A window partition is the part of a source that one range partition holds.
    inside = Window.partitionBy("s", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("row", "doc_id", "size", "s", "part", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("within"))
    placed = placed.join(spans, ["s", "part"]).select("row", "doc_id", "size", "s", (F.col("earlier") + F.col("within")).alias("start"))
    return Mix(stage(placed, "mixing-placed"), sources, block_words)


def schedule(m: Mix) -> DataFrame:
    """(slot, s, rank, pass, block, words): the slots that are filled, words being what the slot takes of its block."""
    spark, sources = m.sources.sparkSession, m.sources.where("need > 0")
    # Cumulative needs: a running sum over range-sorted sources, as for the documents.
    ranged, _ = _numbered(sources, [F.col("s")], "mixing-needs")
    totals = ranged.groupBy("part").agg(F.sum("need").alias("sum"))  # one row a partition
    earlier = totals.select("part", F.coalesce(F.sum("sum").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("need").over(inside), F.lit(0))
    spread = stage(ranged.withColumn("low", low).join(F.broadcast(earlier), "part")
                   .withColumn("low", F.col("low") + F.col("earlier")), "mixing-cumulative")
    needed = int(spread.agg(F.max(F.col("low") + F.col("need"))).first()[0] or 0)
    bits = max(1, (needed - 1).bit_length()) if needed else 0

    # Each source is filed under the cells of units it covers; long covers are laid out in two steps.
    high = F.col("low") + F.col("need")
    coarse = spread.select("s", "source_size", "limit", "blocks", "low", high.alias("high"), F.explode(F.sequence(
        F.expr(f"low div {CELL << 12}"), F.expr(f"(low + need - 1) div {CELL << 12}"))).alias("group"))
    coarse = coarse.repartition("group", "s")
    cells = coarse.select("s", "source_size", "limit", "blocks", "low", "high", F.explode(F.sequence(
        F.greatest(F.expr(f"low div {CELL}"), F.col("group") * 4096),
        F.least(F.expr(f"(high - 1) div {CELL}"), F.col("group") * 4096 + 4095))).alias("cell"))
    unit = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    points = spark.range((1 << bits) if needed else 0).select(F.col("id").alias("slot"))
    points = points.select("slot", unit.alias("unit")).where(F.col("unit") < needed).withColumn("cell", F.expr(f"unit div {CELL}"))
    met = points.join(cells, "cell").where("low <= unit and unit < high").select(
        "slot", "s", "source_size", "limit", "blocks", F.shiftright("slot", RANGE_BITS).alias("range"))
    met = stage(met, "mixing-slots")

    counts = met.groupBy("s", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("s", "range").orderBy("slot")
    ranked = met.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["s", "range"]).withColumn(
        "rank", F.col("rank") + F.col("earlier"))
    ranked = ranked.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    at = F.col("block") * m.block_words
    words = F.least(F.lit(m.block_words), F.col("source_size") - at, F.col("limit") - F.col("pass") * F.col("source_size") - at)
    return ranked.select("slot", "s", "rank", "pass", "block", words.alias("words"))


def segments(m: Mix, slots: DataFrame) -> DataFrame:
    """(slot, s, block, pass, row, doc_id, first, words): the words from ``first`` of a document that a slot takes."""
    b = m.block_words
    parts = m.documents.where("size > 0").select("row", "doc_id", "s", "size", "start", F.explode(F.sequence(
        F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
    joined = slots.join(parts, ["s", "block"])
    first = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    last = F.least(F.col("block") * b + F.col("words") - F.col("start"), F.col("size"))
    return joined.where(last > first).select("slot", "s", "block", "pass", "row", "doc_id", first.alias("first"),
                                             (last - first).alias("words"))


def taken(m: Mix) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): one row per document."""
    sums = segments(m, schedule(m)).groupBy("row").agg(F.sum("words").alias("taken"))
    known = m.sources.select("s", "source", "source_size", "target")
    return m.documents.join(sums, "row", "left").join(known, "s").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
