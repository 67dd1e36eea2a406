"""Cross-tokenizer alignment: groups and overlaps of two tokenizers' tokens over the same bytes.

1. Every whole text is encoded by a byte-level BPE (A: space + text) and by a
   SentencePiece BPE (B: text; the model adds the space).  Texts are cut into
   chunks before a space or line feed that follows a character which is no
   white space.  Both tokenizers begin a token there whatever stands around it
   (A's pattern splits there, no B piece goes on across a space or holds a line
   feed), so a chunk's start is a common end of both, and a chunk is encoded and
   aligned once (steps 2 and 3), in runs of distinct chunks; the task keeps its
   groups and links in a cache bounded in bytes, and a text takes those of its
   chunks.  A model without these properties gets whole texts.
2. The byte ends of A and B are two sorted lists.  Their common ends are found
   by galloping intersection: each end of the shorter list is searched in the
   longer from the last place on, in doubling steps, then by binary search
   between the last two.  The common ends slice both token lists into groups.
3. An A token from byte s to e overlaps the B tokens from rank(s) to rank(e):
   the number of B ends at or below s, and of those below e.  The difference of
   the ranks, plus one, is the number of links of the token.
4. Links are counted by pair of ids within the document and, by task, for the
   corpus; the task sums are added up by a grouping on the pair.  A pair that
   has the highest count of its B id is marked as best.
5. The counts go back to the documents.  Up to ``max_broadcast`` distinct pairs
   (16 bytes each) they are sent to all tasks; beyond that, documents' pairs and
   counts meet in a join on (pair, salt), the salt spreading a pair that very
   many documents hold.  Both ways give the same rows.

Defined results: a null or empty text, and one whose joined A or B bytes differ
from space + text, has no tokens: zeros and an empty digest, and links nothing.
A null id stays null; repeated rows are counted and returned as often as they
occur; an empty table gives no rows.  Only the id and text columns are read, so
further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.packing import ChunkIndex
from logfold.staging import stage

#: Pairs whose counts are sent to every task (about 32 MB); more are joined.
MAX_BROADCAST = 2_000_000
SALTS = 32
#: Bytes of chunks and their alignments that a task keeps, bytes of text it works on at a time, chunks of a text joined
#: at a time, and pairs it sums before they leave.
CACHE_BYTES = 112 << 20
TEXT_BYTES = 2 << 20
RUN_CHUNKS = 20_000
TASK_PAIRS = 300_000
_CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_SHIFT = 32


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices in a and in b of the values that both sorted lists hold, by galloping intersection."""
    swap = len(a) > len(b)
    if swap:
        a, b = b, a
    at_a, at_b, low, n = [], [], 0, len(b)
    for i, end in enumerate(a):
        if low >= n:
            break
        here = b[low]
        if here > end:
            continue
        if here < end:
            step = 1
            while low + step < n and b[low + step] < end:
                low += step  # b[low] stays below end
                step += step
            high = min(low + step, n)
            low += 1
            while low < high:
                mid = (low + high) // 2
                if b[mid] < end:
                    low = mid + 1
                else:
                    high = mid
            if low >= n:
                break
            here = b[low]
        if here == end:
            at_a.append(i)
            at_b.append(low)
            low += 1
    return (at_b, at_a) if swap else (at_a, at_b)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A index, B index) of every link, from the ranks of A's starts and ends among B's ends."""
    starts = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, starts, "right")
    n = np.searchsorted(b_ends, a_ends, "left") - first + 1
    n[a_ends == starts] = 0  # a token without bytes
    total = np.cumsum(n)
    offset = np.arange(total[-1] if n.size else 0) - np.repeat(total - n, n)
    return np.repeat(np.arange(n.size), n), np.repeat(first, n) + offset


class Chunks:
    """Chunks of texts by number: group text, links as pair keys (64-bit, as bytes) and numbers of tokens and groups.

    ``odd`` has the token bytes and ids of chunks whose token bytes are not the chunk's.
    """

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(byte_file)
        tokenizer.encode_special_tokens = True
        self.encode_a = tokenizer.encode_batch_fast
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab = tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, s)) if byte_of.keys() >= set(s) else s.encode()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        n = sp.get_piece_size()
        self.b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(n)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Decimals of the ids followed by each separator; an id's row is separator x ids + id.
        self.ids = max(len(self.a_bytes), n)
        self.decimals = [f"{i}{c}".encode() for c in ",|;" for i in range(self.ids)]
        self.decimal_len = np.array([len(x) for x in self.decimals], np.int64)
        self.space = sp.piece_to_id("▁")
        words = [sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.cut = (sp.normalize(" a \n  b ") == "▁▁a▁\n▁▁b▁" and sp.id_to_piece(self.space) == "▁"
                    and not any("▁" in p.lstrip("▁") or "\n" in p for p in words))
        self.clear()

    def clear(self) -> None:
        self.known, self.held = ChunkIndex(), 0
        self.lines: list[bytes] = []
        self.links: list[bytes] = []
        self.sizes = np.zeros((0, 3), np.int64)
        self.odd: dict[int, tuple[tuple[bytes, bytes], tuple[list[int], list[int]]]] = {}

    def _pieces(self, chunk: str) -> list[int]:
        """B's ids of a chunk as it stands in a text; the model puts a space before whatever it is given."""
        if chunk[0] == " ":
            return self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.space]
        ids = self.sp.encode(chunk)
        if ids[0] != self.space:
            raise ValueError("the piece model joins a space and a line feed")
        return ids[1:]

    def align(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Group texts, links and (A tokens, B tokens, groups) of chunks that follow one another.

        ``a`` and ``b`` are the ids of all, the cuts the numbers of tokens at the chunks' ends, with a zero before.
        """
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at_a, at_b = common_ends(a_ends.tolist(), b_ends.tolist())
        # A token's group is the number of common ends before it; a group's last token has the closing separator.
        last_a, last_b = np.zeros(a.size, np.int64), np.zeros(b.size, np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        rows = np.concatenate([a + self.ids * last_a, b + 2 * self.ids * last_b])[np.argsort(group, kind="stable")]
        line = b"".join(map(self.decimals.__getitem__, rows.tolist()))
        left, right = overlaps(a_ends, b_ends)
        keys = ((a[left] << _SHIFT) + b[right]).astype("<i8").tobytes()
        at_line = np.concatenate([[0], np.cumsum(self.decimal_len[rows])])[a_cut + b_cut].tolist()
        at_link = (8 * np.searchsorted(left, a_cut)).tolist()
        return ([line[lo:hi] for lo, hi in zip(at_line, at_line[1:], strict=False)],
                [keys[lo:hi] for lo, hi in zip(at_link, at_link[1:], strict=False)],
                np.stack([np.diff(a_cut), np.diff(b_cut), np.diff(np.searchsorted(at_a, a_cut))], 1))

    def _learn_alone(self, chunk: str) -> tuple[list[bytes], list[bytes], np.ndarray]:
        a, b = self.encode_a([chunk], add_special_tokens=False)[0].ids, self._pieces(chunk)
        joined = b"".join([self.a_bytes[i] for i in a]), b"".join([self.b_bytes[i] for i in b])
        data = chunk.encode()
        if joined != (data, data):
            self.odd[self.known[chunk]] = joined, (a, b)
            return [b""], [b""], np.zeros((1, 3), np.int64)
        return self.align(np.array(a), np.array(b), np.array([0, len(a)]), np.array([0, len(b)]))

    def _learn_together(self, chunks: list[str]) -> tuple[list[bytes], list[bytes], np.ndarray] | None:
        """Encode and align chunks as one text; None if a token goes on beyond a chunk's end."""
        text = "".join(chunks)
        data, ends = text.encode(), np.cumsum([len(c.encode()) for c in chunks])
        both, cuts = [], []
        for ids, size, bytes_of in ((self.encode_a([text], add_special_tokens=False)[0].ids, self.a_len, self.a_bytes),
                                    (self._pieces(text), self.b_len, self.b_bytes)):
            both.append(np.array(ids))
            token_ends = np.cumsum(size[both[-1]])
            at = np.searchsorted(token_ends, ends)
            if token_ends[-1] != ends[-1] or (token_ends[at] != ends).any() or b"".join([bytes_of[i] for i in ids]) != data:
                return None
            cuts.append(np.concatenate([[0], at + 1]))
        return self.align(*both, *cuts)

    def learn(self, texts: list[str]) -> list[list[int]]:
        """The chunks' numbers of space + text of every text, all of them aligned afterwards."""
        if self.held > CACHE_BYTES:
            self.clear()
        number = self.known.__getitem__
        cuts = [list(map(number, _CHUNK.findall(" " + t) if self.cut else [" " + t])) for t in texts]
        new, self.known.pending = self.known.pending, []
        base, sizes = len(self.lines), np.zeros((len(new), 3), np.int64)
        self.lines += [b""] * len(new)
        self.links += [b""] * len(new)

        def keep(where: list[int], found: tuple[list[bytes], list[bytes], np.ndarray]) -> None:
            for i, line, links in zip(where, *found[:2], strict=True):
                self.lines[base + i], self.links[base + i] = line, links
                self.held += 2 * len(new[i]) + len(line) + len(links) + 300
            sizes[where] = found[2]

        # Only chunks that end in no white space can be followed by another chunk.
        alone = [not self.cut or c[-1:].isspace() or "▁" in c or len(c) > 200 for c in new]
        rest = [i for i, x in enumerate(alone) if not x]
        for lo in range(0, len(rest), 256):
            block = rest[lo:lo + 256]
            if found := self._learn_together([new[i] for i in block]):
                keep(block, found)
            else:
                for i in block:
                    alone[i] = True
        for i, x in enumerate(alone):
            if x:
                keep([i], self._learn_alone(new[i]))
        self.sizes = np.concatenate([self.sizes, sizes])
        return cuts

    def tokens(self, cuts: list[int], text: str) -> list[tuple[bytes, bytes]]:
        """(A ids, B ids), 32-bit, of a text's chunks; none if the joined bytes of a tokenizer differ from space + text."""
        if not self.whole(cuts, text):
            return []
        out = []
        for n in cuts:
            if n in self.odd:
                ids = self.odd[n][1]
            else:
                groups = [g.split(b"|") for g in self.lines[n][:-1].split(b";")]
                ids = [[int(i) for g in groups for i in g[k].split(b",")] for k in (0, 1)]
            out.append(tuple(np.array(x, "<u4").tobytes() for x in ids))
        return out

    def whole(self, cuts: list[int], text: str) -> bool:
        """Whether both tokenizers' joined bytes of a text's chunks are space + text."""
        if not self.odd or self.odd.keys().isdisjoint(cuts):
            return True
        data = (" " + text).encode()
        if not self.cut:
            return self.odd[cuts[0]][0] == (data, data)
        chunks = [c.encode() for c in _CHUNK.findall(" " + text)]
        return all(b"".join([self.odd[n][0][k] if n in self.odd else c for n, c in zip(cuts, chunks, strict=True)]) == data
                   for k in (0, 1))

    def joined(self, cuts: list[int], text: str) -> tuple[np.ndarray, bytes, np.ndarray]:
        """((A tokens, B tokens, groups), group text, links as pair keys) of chunks that follow one another in a text."""
        if self.odd and not self.odd.keys().isdisjoint(cuts):  # equal as a whole only: no chunk's end need be a common end
            a, b = (np.frombuffer(b"".join([c[k] for c in self.tokens(cuts, text)]), "<u4").astype(np.int64) for k in (0, 1))
            (line,), (links,), (size,) = self.align(a, b, np.array([0, a.size]), np.array([0, b.size]))
        else:
            line, links = (b"".join(map(x.__getitem__, cuts)) for x in (self.lines, self.links))
            size = self.sizes[cuts].sum(0)
        return size, line[:-1], np.frombuffer(links, "<i8")


class PairSums:
    """Counts by pair key, summed as they come; ``keys`` and ``counts`` after ``flush``."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += keys.size
        if self.held > TASK_PAIRS:
            self.flush()

    def flush(self) -> None:
        keys, where = np.unique(np.concatenate([self.keys, *[p[0] for p in self.parts]]), return_inverse=True)
        counts = np.zeros(keys.size, np.int64)
        np.add.at(counts, where, np.concatenate([self.counts, *[p[1] for p in self.parts]]))
        self.keys, self.counts, self.parts, self.held = keys, counts, [], 0


def align_text(text: str | None, cuts: list[int], chunks: Chunks) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, digest, pair keys, their counts) of a whole text, cut into known chunks."""
    if not text or not chunks.whole(cuts, text):
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, n_links = np.zeros(3, np.int64), 0
    sums, digest = PairSums(), hashlib.sha256()
    run = len(cuts) if chunks.odd and not chunks.odd.keys().isdisjoint(cuts) else RUN_CHUNKS
    for lo in range(0, len(cuts), run):
        size, line, links = chunks.joined(cuts[lo:lo + run], text)
        total, n_links = total + size, n_links + links.size
        digest.update(b";" + line if lo else line)
        sums.add(*np.unique(links, return_counts=True))
    if len(sums.parts) == 1 and not sums.keys.size:
        sums.keys, sums.counts = sums.parts[0]
    else:
        sums.flush()
    return *total.tolist(), n_links, digest.hexdigest(), sums.keys, sums.counts


def align_texts(texts: list[str | None], chunks: Chunks) -> Iterator[tuple]:
    """``align_text`` of every text, in runs of about ``TEXT_BYTES`` or one longer text."""
    lo, size = 0, 0
    for hi, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= TEXT_BYTES or hi == len(texts):
            part = texts[lo:hi]
            cuts = iter(chunks.learn([t for t in part if t]))
            yield from [align_text(t, next(cuts) if t else [], chunks) for t in part]
            lo, size = hi, 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *[x.size for x in arrays]])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts", "total"]


def aligned(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts, total).

    A row per document, with its pairs of ids and their links; rows marked ``total`` hold the sums of a task.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batch(ids: pa.Array, rows: list[tuple], total: bool) -> pa.RecordBatch:
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays(
            [ids, *cols, pa.array([r[4] for r in rows], pa.string()), _lists([r[5] for r in rows]), _lists([r[6] for r in rows]),
             pa.array([total] * len(rows), pa.bool_())], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, sums = Chunks(byte_file, piece_file), PairSums()  # both end with the task

        def sent() -> pa.RecordBatch:
            sums.flush()
            out = batch(pa.nulls(1, pa.int64()), [(0, 0, 0, 0, "", sums.keys, sums.counts)], True)
            sums.reset()
            return out

        for b in batches:
            for part in (b.slice(lo, 500) for lo in range(0, b.num_rows, 500)):
                rows = []
                for found in align_texts(part.column(1).to_pylist(), chunks):
                    rows.append(found)
                    sums.add(*found[5:])
                yield batch(part.column(0), rows, False)
                if sums.keys.size > TASK_PAIRS:
                    yield sent()
        yield sent()

    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, "
              "counts array<long>, total boolean")
    return stage(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "alignment-documents")


def pair_counts(found: DataFrame) -> DataFrame:
    """Stored (pair, n, best) of all documents; best: n is the highest of the pair's B id, ties included.

    A window over a B id holds one row per A id at most, so the vocabulary bounds it.
    """
    each = found.where("total").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    sums = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << _SHIFT) - 1)))
    return stage(sums.withColumn("best", F.col("n") == top), "alignment-pairs")


def _scored_by_broadcast(found: DataFrame, pairs: DataFrame) -> DataFrame:
    table = pairs.toArrow()  # at most max_broadcast rows
    keys, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    shared = found.sparkSession.sparkContext.broadcast((keys[order], n[order], best[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for b in batches:
            pairs, links = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (6, 7))
            size = b.column(6).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([[0], size])).astype(np.int64)
            at = np.searchsorted(keys, pairs)
            sums = []
            for value in (best, n):
                total = np.concatenate([[0], np.cumsum(links * value[at])])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *sums], [*_NAMES[:6], "n_best", "count_sum"])

    return found.select(*_NAMES[:8]).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                                     "groups_sha256 string, n_best long, count_sum long")


def _scored_by_join(found: DataFrame, pairs: DataFrame) -> DataFrame:
    salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = found.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(
        "row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links"))
    sums = each.join(salted, ["pair", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "row", "left").select(*_NAMES[:6], F.coalesce("n_best", zero).alias("n_best"),
                                                  F.coalesce("count_sum", zero).alias("count_sum"))


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text",
                    max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum): one row per document."""
    stored = aligned(docs, byte_file, piece_file, id_col, text_col)
    pairs, found = pair_counts(stored), stored.where("not total")
    return (_scored_by_broadcast if pairs.count() <= max_broadcast else _scored_by_join)(found, pairs)
