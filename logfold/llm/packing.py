"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Every whole document is tokenised in an Arrow pass (token ids are cached
   per white-space chunk, for the task and bounded in bytes; the tokenizer never joins tokens across white space)
   and only documents beyond the capacity are cut.  The chunks of a run of texts are found, numbered and
   replaced by their ids as whole arrays; only distinct ones are looked up one by one.
2. Pieces are range-sorted by length (with a hash as tie-breaker, so a very
   common length spans many partitions), which gives each piece its rank among
   the pieces of its length: its rank in its partition plus the number in
   earlier partitions.
3. Bulk-synchronous rounds match piece lengths with gaps, all in Spark tables.
   Pieces of one length are interchangeable, so a table holds runs: (length,
   next rank, count) and (gap, first sequence, count).  A round range-sorts
   runs and gaps together by size; each task sweeps its range from the longest
   and gives every run its successor, the smallest gap that holds it; conflicts
   over a gap are resolved by rank (longer lengths, then earlier pieces, first);
   moves, updated gaps and waiting runs are written, and the next round begins.
   Runs that no gap holds open new sequences.  A round uses a task for every
   ``RUNS_PER_TASK`` rows; a round that moved nothing (the gaps were in other
   ranges) is followed by one with half the tasks.  Only sums over the tables
   reach the driver.
4. Moves and pieces are range-sorted together by (length, rank); a piece belongs
   to the last move before it, carried within a partition by a scan and across
   partitions by one row each.

Defined results: a null text is an empty document (one piece, the end token
alone); a null id stays null; repeated rows are packed as separate documents.
An empty table gives no rows.  Pieces of equal length are ordered by a hash of
their columns; which of two identical rows goes where is undefined.
Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.llm.workers import tidy, worker_state
from logfold.staging import stage

CAPACITY = 4096
END_ID = 1
#: Bytes of cached chunks (with about 150 each for the tables) in a task, and bytes of text tokenised at a time.
CACHE_BYTES = 64 << 20
TEXT_BYTES = 1 << 20
#: Kinds of bytes, for chunks: lower-case letters, punctuation and white space of ASCII, others.
_LETTER, _PUNCTUATION, _SPACE = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _PUNCTUATION
_KINDS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz"]] = _LETTER
_KINDS[[*b" \t\n\r\x0b\x0c"]] = _SPACE
#: Runs and gaps that one task sweeps in a round.
RUNS_PER_TASK = 1 << 14
#: Kinds of rows in the tables of a round; gaps sort before runs of their size.
GAP, RUN, MOVE = 0, 1, 2
_STATE = "kind int, size long, first long, many long, sequence long, per long, offset long"


class ChunkIndex(dict):
    """Numbers for chunks in the order of their first use; ``pending`` are those not yet tokenised."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.pending.append(chunk)
        return n


class ChunkTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes, through a cache of chunks.

    Chunks end at ASCII white space, and before ASCII punctuation that follows an
    ASCII letter: the tokenizer splits there in any case.  ASCII capitals are folded,
    as the tokenizer does.  A text that may hold a special token is cut at white
    space only.
    """

    def __init__(self, tokenizer_file: str):
        # Spark runs a task per core: the library's own threads would only add memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode = tokenizer.encode_batch_fast
        vocab = tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index, self.held = ChunkIndex(), 0
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # of all chunks, and where each ends

    def chunks(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct chunks, place of every chunk among them, number of chunks up to each text's end)."""
        special = [b"<|" in t for t in texts]
        data = np.frombuffer(b" ".join([t if s else t.lower() for t, s in zip(texts, special, strict=True)]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = _KINDS[data]
        solid = kinds != _SPACE
        begins, cut = solid.copy(), (kinds[1:] == _PUNCTUATION) & (kinds[:-1] == _LETTER)
        for k in np.flatnonzero(special).tolist():
            cut[ends[k] - len(texts[k]):ends[k]] = False
        begins[1:] &= ~solid[:-1] | cut
        count = np.searchsorted(np.flatnonzero(begins), ends)
        offsets = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), offsets.size - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
        found = found.dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), count

    def _tokenise(self) -> None:
        """Add the ids of the pending chunks; chunks of letters alone share calls, each is one word."""
        texts = [c.decode() for c in self.index.pending]
        self.held += sum(map(len, self.index.pending)) + 150 * len(texts)
        self.index.pending = []
        parts = [b""] * len(texts)
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        alone = [i for i, t in enumerate(texts) if not t.isalpha()]
        blocks = [words[i:i + 256] for i in range(0, len(words), 256)]
        found = self.encode([" ".join([texts[i] for i in b]) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, found, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if ends.size != len(block) or ends[-1] != ids.size:  # not one word each after all
                alone += block
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            for i, lo, hi in zip(block, [0, *ends[:-1]], ends, strict=True):
                parts[i] = raw[lo:hi]
        found = self.encode([texts[i] for i in alone], add_special_tokens=False)
        for i, e in zip(alone, found, strict=True):
            parts[i] = np.array(e.ids, "<u4").tobytes()
        ids = np.frombuffer(b"".join(parts), "<u4")
        self.held += ids.nbytes
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])

    def texts(self, texts: list[bytes]) -> list[bytes]:
        distinct, places, count = self.chunks(texts)
        numbers = np.array(list(map(self.index.__getitem__, distinct)), np.int64)
        if self.index.pending:
            self._tokenise()
        first, size = self.ends[numbers][places], np.diff(self.ends)[numbers][places]
        ends = np.cumsum(size)
        where = np.repeat(first - ends + size, size)
        where += np.arange(where.size)
        raw = self.ids[where].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[count]).tolist()
        if self.held > CACHE_BYTES:
            self.clear()
        return [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]


def piece_table(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    size = 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:5 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_state(("packing", tokenizer_file), lambda: ChunkTokenizer(tokenizer_file))

        def pieces(rows: list[int], texts: list[bytes], part: pa.RecordBatch) -> Iterator[tuple]:
            for k, ids in zip(rows, tokenizer.texts(texts), strict=True):
                ids += end
                for piece, lo in enumerate(range(0, len(ids), size)):
                    cut = ids[lo:lo + size]
                    yield part.column(0)[k].as_py(), piece, lo // 4, len(cut) // 4, zlib.crc32(cut), cut

        for b in batches:
            rows, texts, held, out = [], [], 0, []
            for k in range(b.num_rows):
                x = b.column(1)[k]
                texts.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
                rows.append(k)
                held += len(texts[-1])
                if held >= TEXT_BYTES or k + 1 == b.num_rows:
                    out += pieces(rows, texts, b)
                    rows, texts, held = [], [], 0
                if out and (with_ids or k + 1 == b.num_rows) and not rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds)], names)  # noqa: B905
                    out = []
        tokenizer.clear()  # the worker goes on to other stages

    return src.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sweep(rows: Iterable[tuple[int, int, int, int]], capacity: int) -> Iterator[tuple]:
    """One range of a round: (kind, size, first, many) from the largest size, gaps before runs of their size.

    Yields moves (MOVE, length, first rank, count, first sequence, pieces a sequence, offset), updated and
    untouched gaps and runs that wait.  Piece ``rank`` of a move goes to sequence ``first sequence + i // per``
    at ``offset + (i % per) * length`` with i = rank - first rank.
    """
    gaps: list[tuple[int, int, int]] = []  # those that hold the current length, the smallest on top
    for kind, size, rank, left in rows:
        if kind == GAP:
            gaps.append((size, rank, left))
            continue
        while left and gaps:
            gap, sequence, free = gaps.pop()
            per = gap // size
            full = min(free, left // per)
            if full:
                yield MOVE, size, rank, full * per, sequence, per, capacity - gap
                yield GAP, gap - per * size, sequence, full, None, None, None
                rank, left, sequence, free = rank + full * per, left - full * per, sequence + full, free - full
            if free and left:  # the last few pieces of this length share one sequence
                yield MOVE, size, rank, left, sequence, per, capacity - gap
                yield GAP, gap - left * size, sequence, 1, None, None, None
                left, sequence, free = 0, sequence + 1, free - 1
            if free:
                gaps.append((gap, sequence, free))
        if left:
            yield RUN, size, rank, left, None, None, None
    for gap in gaps:
        yield GAP, *gap, None, None, None


def match_rounds(lengths: DataFrame, capacity: int, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """Moves (size, first, many, sequence, per, offset) that place all pieces of ``lengths`` (size, many)."""
    names = [f.split()[0] for f in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = list(sweep((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)), capacity))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    def rows(df: DataFrame, kind: int, size, first, many) -> DataFrame:
        values = [F.lit(kind), size, first, many, F.lit(None), F.lit(None), F.lit(None)]
        return df.select(*(v.cast("int" if n == "kind" else "long").alias(n) for n, v in zip(names, values, strict=True)))

    spark, size, kind = lengths.sparkSession, F.col("size"), F.col("kind")
    state = stage(rows(lengths, RUN, size, F.lit(0), F.col("many")), "packing-round")
    moves = state.where(kind == MOVE)
    opened, before, tasks = 0, -1, 1
    while True:
        s = state.agg(F.sum(F.when(kind == RUN, F.col("many"))).alias("left"), F.min(F.when(kind == RUN, size)).alias("least"),
                      F.max(F.when(kind == GAP, size)).alias("largest"), F.count("*").alias("n")).first()
        if not s.left:
            return moves
        now = state.where((kind == RUN) | (size >= s.least))
        stuck = state.where((kind == RUN) & (size > (s.largest or 0))).agg(F.sum(size * F.col("many"))).first()[0]
        new = -(-(stuck or 0) // capacity)  # no gap holds these: at least so many new sequences are needed
        if new:
            now = now.union(rows(spark.range(1), GAP, F.lit(capacity), F.lit(opened), F.lit(new)))
            opened += new
        tasks = tasks // 2 if s.left == before and tasks > 1 else -(-s.n // runs_per_task)
        before = s.left
        order = [size.desc(), kind, F.col("first")]
        ranged = now.repartitionByRange(tasks, *order) if tasks > 1 else now.coalesce(1)
        swept = stage(ranged.sortWithinPartitions(*order).mapInArrow(tidy(run), _STATE), "packing-round")
        state = swept.where((kind < MOVE) & (size > 0))
        moves = moves.union(swept.where(kind == MOVE))


def _ranked(pieces: DataFrame, length_col: str) -> DataFrame:
    """(size, at, row): every piece as a struct, with its rank among the pieces of its length."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select(F.col(length_col).cast("long").alias("size"), F.struct(*pieces.columns).alias("row"))
    order = [F.col("size").desc(), F.xxhash64("row")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(0).to_numpy()
            head = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]]))
            base = np.repeat(head, np.diff(np.append(head, size.size)))
            rank = np.arange(size.size) - base
            if size[0] == last:
                rank[:head[1] if head.size > 1 else size.size] += seen
            last, seen = int(size[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(size.size, part, np.int32)), pa.array(rank.astype(np.int64))],
                ["size", "row", "part", "at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    ranked = stage(ranged.mapInArrow(tidy(number), schema), "packing-ranked")
    # As many rows as partitions and lengths together: a sorted partition holds few lengths.
    runs = ranked.groupBy("size", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = runs.select("size", "part", F.coalesce(earlier, F.lit(0)).alias("shift"))
    return ranked.join(shift, ["size", "part"]).select("size", (F.col("at") + F.col("shift")).alias("at"), "row")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length",
         runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """``pieces`` with sequence_id and offset; no sequence is longer than ``capacity``."""
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = pieces.groupBy(F.col(length_col).cast("long").alias("size")).agg(F.count("*").alias("many"))
    moves = match_rounds(lengths, capacity, runs_per_task)
    ranked = _ranked(pieces, length_col)
    both = moves.select("size", F.col("first").alias("at"), "kind", F.col("first"), "sequence", "per", "offset").unionByName(
        ranked.withColumn("kind", F.lit(MOVE + 1)), allowMissingColumns=True)
    order = ["size", "at", "kind"]
    held = ["first", "sequence", "per", "offset"]
    names = ["size", "at", "row", *held, "part"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, row_type = TaskContext.get().partitionId(), None, None
        for b in batches:
            b = b.select(["size", "at", "row", *held, "kind"])
            row_type = b.column(2).type
            kind = b.column(7).to_numpy()
            piece = kind != MOVE
            before = np.maximum.accumulate(np.where(piece, -1, np.arange(kind.size)))
            keep, known = pa.array(piece), (before >= 0) | (last is not None)
            values = [c.fill_null(0).to_numpy() for c in b.columns[3:7]]
            filled = [np.where(before >= 0, v[before], old) for v, old in zip(values, last or [0] * 4, strict=True)] if kind.size else values
            yield pa.RecordBatch.from_arrays(
                [*(c.filter(keep) for c in b.columns[:3]), *(pa.array(f[piece], pa.int64(), mask=~known[piece]) for f in filled),
                 pa.array(np.full(int(piece.sum()), part, np.int32))], names)
            if kind.size and before[-1] >= 0:
                last = [int(v[before[-1]]) for v in values]
        if row_type is not None:  # the partition's last move, for the pieces that begin later partitions
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, row_type),
                 *(pa.array([x], pa.int64()) for x in last or [None] * 4), pa.array([part], pa.int32())], names)

    longs = [T.StructField(x, T.LongType()) for x in ("size", "at")]
    schema = T.StructType([*longs, T.StructField("row", ranked.schema["row"].dataType),
                           *(T.StructField(x, T.LongType()) for x in held), T.StructField("part", T.IntegerType())])
    placed = stage(both.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(tidy(carry), schema), "packing-placed")
    ends, found = [], None
    for r in sorted(placed.where("size is null").collect(), key=lambda r: r.part):  # one row a partition
        ends.append((r.part, *(found or [None] * 4)))
        found = [r[x] for x in held] if r["first"] is not None else found
    entering = spark.createDataFrame(ends, "part int, first0 long, sequence0 long, per0 long, offset0 long")
    rows = placed.where("size is not null").join(F.broadcast(entering), "part", "left")
    first, sequence, per, offset = (F.coalesce(F.col(x), F.col(f"{x}0")) for x in held)
    i = F.col("at") - first
    return rows.select("row.*", (sequence + ((i - i % per) / per).cast("long")).alias("sequence_id"),
                       (offset + i % per * F.col("size")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    pieces = stage(piece_table(docs, tokenizer_file, id_col, text_col, capacity, end_id), "packing-pieces")
    return pack(pieces, capacity)
