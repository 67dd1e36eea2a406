"""Quotation linking: reply-ordered conversations without their quotes.

1. An Arrow pass parses every whole message into lines with nested quote
   levels (the number of leading ``>``), separates its own text from the quoted
   passages (runs of lines of one level) and from attribution lines, and hashes
   the normalised passages (lower case, single spaces): of a quoted run and of
   the own text alike the whole, each paragraph and each line.  Paragraphs end
   at blank lines; those of the own text also where a quote comes between.  An
   own passage of fewer than ``min_chars`` characters counts only if it is the
   whole own text, so a line like "ok" inside a message is no original.
2. Only conversations in which something is quoted file their own passages.
   Quoted and own passages are range-sorted by (conversation, hash, turn); the
   original of a quoted passage is the nearest earlier message that holds it,
   carried forward in a partition and, at its first key, from earlier ones.  So
   nothing multiplies, and a passage that very many messages hold or quote is
   spread over partitions.
3. A message's parent is the original of its shallowest linked level, the one
   with the most characters, the latest on ties.  Threads are the components
   of the parent links; their root is their first message.
4. Reply order: each thread is a tree, read depth first, answers by turn.  Its
   Euler tour is a linked list (into the first answer, on to the next answer to
   the same message, back to the parent), ranked by pointer doubling: joins
   on unique keys, as many rounds as the logarithm of the longest thread.
5. Messages are range-sorted by conversation, first turn of the thread and
   reply order, on narrow rows.  Positions come from the rank in the partition
   and the counts of earlier ones, and are joined to the texts at the end.

Defined results: a null text stays null and has no passages; a text of quotes
alone becomes empty; very long texts are parsed whole; an unlinked message is
its own thread; a null turn or conversation never links and sorts first; equal
turns answer none of each other and sort in any order; repeated rows keep their
own positions; an empty table gives no rows.  Only the four named columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.graphs import connected_components
from logfold.staging import stage

_QUOTE = re.compile(r"(?:[ \t]*>)+ ?")
_ATTRIBUTION = re.compile(r".*\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*")


#: Own passages shorter than this are originals only as whole texts.
MIN_CHARS = 6
#: Conversations with quotes that are sent to every task (8 bytes each); more are joined.
MAX_BROADCAST = 1_000_000


def normalise(passage: str) -> str:
    return " ".join(passage.lower().split())


def _hash(passage: str) -> bytes:
    return hashlib.sha256(passage.encode("utf-8", "surrogatepass")).digest()


def _paragraphs(text: str) -> list[str]:
    return re.split(r"\n\s*\n", text)


def parse_message(text: str, min_chars: int = MIN_CHARS) -> tuple[str, list[bytes], list[tuple[int, int, int, bytes]], int]:
    """(own text, hashes of own passages, (run, level, characters, hash) of quoted ones, quoted runs)."""
    lines = []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        lines.append((m[0].count(">") if m else 0, line[m.end():] if m else line))
    own, parts, runs = [], [[]], []
    for k, (level, line) in enumerate(lines):
        ahead = next((v for v, s in lines[k + 1:k + 3] if v or s.strip()), 0)
        if level:
            if runs and runs[-1][0] == level and runs[-1][2] == k - 1:
                runs[-1][1].append(line)
                runs[-1][2] = k
            else:
                runs.append([level, [line], k])
            if parts[-1]:
                parts.append([])
        elif not (ahead and _ATTRIBUTION.fullmatch(line)):
            own.append(line)
            parts[-1].append(line)
    body = "\n".join(own).strip("\n") if runs else text
    between = [x for part in parts for x in _paragraphs("\n".join(part))]
    whole = normalise(body)
    parts_of = {normalise(x) for x in (*_paragraphs(body), *between, *body.split("\n"))}
    passages = {whole, *(x for x in parts_of if len(x) >= min_chars)} - {""}
    quoted = []
    for r, (level, part, _) in enumerate(runs):
        for p in {normalise(x) for x in (" ".join(part), *_paragraphs("\n".join(part)), *part)} - {""}:
            quoted.append((r, level, len(p), _hash(p)))
    return body, [_hash(p) for p in sorted(passages)], sorted(quoted), len(runs)


def parse_messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
                   min_chars: int = MIN_CHARS) -> DataFrame:
    src = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                          F.col(text_col).cast("string").alias("text"))
    from pyspark.sql.types import StructType, _parse_datatype_string
    extra = ("text string, passages array<binary>, quoted array<struct<run:int,level:int,chars:int,hash:binary>>, "
             "n_quotes int")
    schema = StructType([*src.schema.fields[:3], *_parse_datatype_string(extra).fields])
    quote = pa.list_(pa.struct([("run", pa.int32()), ("level", pa.int32()), ("chars", pa.int32()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None, [], [], 0) if (t := x.as_py()) is None else parse_message(t, min_chars) for x in b.column(3)]
            quoted = [[dict(zip(("run", "level", "chars", "hash"), q, strict=True)) for q in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary())),
                 pa.array(quoted, quote), pa.array([r[3] for r in rows], pa.int32())],
                ["conv_id", "turn", "role", "text", "passages", "quoted", "n_quotes"])

    return stage(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "quotes-parsed")


def last_before(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` among earlier rows (in ``order``) with the same ``keys``.

    The rows are range-sorted, so very many rows of one key spread over
    partitions.  Inside a partition a window carries the value on; only the
    first key of a partition can have rows in earlier ones, whose last values
    are one row per partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns
    by = [*[F.col(k) for k in keys], *order]
    ranged = rows.withColumn("_value", value).repartitionByRange(n, *by).sortWithinPartitions(*by)
    ranged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
                   .withColumn("_key", F.struct(*keys)), "quotes-scan")
    ends = ranged.groupBy("_part").agg(F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    ends = stage(ends, "quotes-ends")  # one row a partition
    tails = ranged.join(F.broadcast(ends), "_part").where(F.col("_key") == F.col("last")).groupBy("_part", "_key").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("tail"))
    nothing = F.lit(None).cast(ranged.schema["_value"].dataType)
    steps = tails.select("_key", "_part", F.lit(1).alias("step"), "tail").unionAll(
        ends.select("first", "_part", F.lit(0).alias("step"), nothing.alias("tail")))
    earlier = Window.partitionBy("_key").orderBy("_part", "step").rowsBetween(Window.unboundedPreceding, -1)
    entering = steps.withColumn("_enter", F.last("tail", ignorenulls=True).over(earlier)).where("step = 0").select("_key", "_part", "_enter")
    inside = Window.partitionBy("_part", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(
        F.broadcast(entering), ["_key", "_part"], "left")
    return out.select(*columns, F.coalesce("_inside", "_enter").alias(name))


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(row, parent, parent_turn, n_linked) of the messages with a linked quote."""
    placed = parsed.where("conv_id is not null and turn is not null")
    asked = placed.where("n_quotes > 0").select("row", "conv_id", "turn", F.explode("quoted").alias("q")).select(
        "conv_id", "turn", "row", F.col("q.hash").alias("hash"), F.lit(0).alias("holds"), "q.run", "q.level", "q.chars")
    asking = stage(placed.where("n_quotes > 0").select("conv_id").distinct(), "quotes-asking")
    few = asking.count() <= MAX_BROADCAST
    held = placed.join(F.broadcast(asking) if few else asking, "conv_id", "left_semi").select(
        "conv_id", "turn", "row", F.explode("passages").alias("hash"))
    none = F.lit(None).cast("int")
    held = held.select("conv_id", "turn", "row", "hash", F.lit(1).alias("holds"), none.alias("run"), none.alias("level"), none.alias("chars"))
    # At one turn the questions come first, so an original is always earlier; of its holders at one turn the smallest row.
    order = [F.col("turn"), F.col("holds"), F.col("row").desc()]
    holder = F.when(F.col("holds") == 1, F.struct("turn", "row"))
    found = last_before(asked.unionByName(held), ["conv_id", "hash"], order, holder, "origin").where("holds = 0 and origin is not null")
    rank = F.struct((-F.col("level")).alias("level"), F.col("chars").alias("chars"), F.col("origin.turn").alias("turn"),
                    F.col("origin.row").alias("row"))
    best = found.groupBy("row").agg(F.max_by("origin", rank).alias("p"), F.size(F.collect_set("run")).alias("n_linked"))
    return stage(best.select("row", F.col("p.row").alias("parent"), F.col("p.turn").alias("parent_turn"), "n_linked"), "quotes-links")


def reply_order(members: DataFrame) -> DataFrame:
    """(row, after): for each message (row, turn, parent) of the threads, the messages from it to the end of a depth-first reading.

    ``parent`` is null for the first message of a thread.  The larger ``after``,
    the earlier the message is read.
    """
    first = members.where("parent is not null").groupBy(F.col("parent").alias("p_row")).agg(
        F.min(F.struct("turn", "row"))["row"].alias("first"))
    # In descending order the row before is the next answer to the same message.
    answers = last_before(members.where("parent is not null").select("row", "turn", "parent"), ["parent"],
                          [F.col("turn").desc(), F.col("row").desc()], F.col("row"), "next")
    steps = members.join(first, F.col("row") == F.col("p_row"), "left").join(answers.select("row", "next"), "row", "left")
    into, out = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    tour = steps.select(F.explode(F.array(
        F.struct(into("row").alias("at"), F.coalesce(into("first"), out("row")).alias("to"), F.lit(1).cast("long").alias("n")),
        F.struct(out("row").alias("at"), F.coalesce(into("next"), out("parent")).alias("to"), F.lit(0).cast("long").alias("n")),
    )).alias("s")).select("s.*")
    tour = stage(tour, "quotes-tour")
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
        tour = stage(tour.join(ahead, "to", "left").select(
            "at", F.col("further").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "quotes-tour")
    return tour.where("at % 2 = 0").select(F.shiftright("at", 1).alias("row"), F.col("n").alias("after"))


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(conv_id, position, turn, role, parent_turn, thread_turn, n_quotes, n_linked, text): one row per message."""
    parsed = parse_messages(messages, conv_col, turn_col, role_col, text_col, min_chars)
    links = link_quotes(parsed)
    threads = connected_components(links.select(F.col("row").alias("a"), F.col("parent").alias("b")))
    members = threads.withColumnRenamed("node", "row").unionAll(
        threads.select(F.col("root").alias("row"), "root")).distinct()
    turns = members.join(parsed.select("row", "turn"), "row").join(links, "row", "left")
    turns = stage(turns, "quotes-threads")
    first = turns.groupBy("root").agg(F.min("turn").alias("thread_turn"))
    ordered = turns.join(first, "root").join(reply_order(turns.select("row", "turn", "parent")), "row").select(
        "row", "root", "thread_turn", "after", "parent_turn", "n_linked")
    narrow = parsed.select("row", "conv_id", "turn").join(ordered, "row", "left").withColumn(
        "thread_turn", F.coalesce("thread_turn", "turn"))
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("thread_turn"), F.coalesce("root", "row"), F.col("after").desc(), F.col("row")]
    sorted_rows = stage(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "quotes-sorted")
    spans = sorted_rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("conv_id").alias("s_conv"), F.col("part").alias("s_part"), "first",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    placed = sorted_rows.join(spans, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("part") == F.col("s_part"))).select(
        "row", (F.col("at") - F.col("first") + F.col("earlier")).alias("position"), "parent_turn", "thread_turn", "n_linked")
    return parsed.select("row", "conv_id", "turn", "role", "text", "n_quotes").join(placed, "row").select(
        "conv_id", "position", "turn", "role", "parent_turn", "thread_turn", "n_quotes",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text")
