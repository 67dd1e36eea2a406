"""SentencePiece encoding and decoding; segmentations sampled without replacement.

The lattice of a text has an edge for every vocabulary piece (bytes for a
character without one).  A word begins with all space marks before it, and
pieces of several marks are edges within it.  No usable piece crosses the start
of a word, so the lattice is a chain of word lattices, built once per distinct
word and task.  A model with pieces that cross it (a mark after another
character) has each whole text as one word.

Gumbel top-k: the leaves (segmentations) of the lattice, perturbed with Gumbel
noise, in decreasing order are samples without replacement.  The noise is drawn
top-down: a node's perturbed maximum is dealt to its children conditioned on
their maximum being the parent's.  A-star search pops the node with the largest
perturbed maximum (an exact bound: a leaf under it attains it) and emits leaves
as they are popped.  For the same reason only the k + 1 best open nodes can
matter, so the queue stays that short however long the text is.  The value of
leaf k + 1 is the threshold t of the inclusion score 1 - exp(-exp(log_prob - t)).

Each row's noise is seeded by its key, so results do not depend on partitions.

Defined results: a null or empty text has one segmentation, the empty one
(log_prob 0, inclusion 1); a text with fewer than k segmentations returns all
of them, with inclusion 1; rows with equal keys and texts get equal samples;
null keys count as the word null.  Only the key and text columns are read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.workers import worker_state

SAMPLES = 2
#: Sharpness of the sampling distribution: weights are (piece probability) ** ALPHA.
ALPHA = 1.0
CACHE_WORDS = 100_000
CACHE_CHARS = 48
_WORDS = re.compile("▁+[^▁]*|[^▁]+")


class Lattice:
    """Word lattices of a SentencePiece model with conditional branch probabilities."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        crossing = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in usable)
        self.words = re.compile(".+", re.S) if crossing else _WORDS
        scores = {i: sp.get_score(i) for i in usable}
        least = min(scores.values())
        if least < -1000:  # merge ranks, not log probabilities: a Zipf law over the ranks
            scores = {i: -math.log(1 - s) for i, s in scores.items()}
            norm = math.log(sum(map(math.exp, scores.values())))
            scores = {i: s - norm for i, s in scores.items()}
            least = min(scores.values())
        self.pieces = {sp.id_to_piece(i): (i, alpha * s) for i, s in scores.items()}
        # Beginnings of pieces that are no pieces themselves: a scan stops at the first string that is neither.
        starts = {p[:j] for p in self.pieces for j in range(1, len(p))}
        self.scan = dict.fromkeys(starts) | self.pieces
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = alpha * (least - math.log(256))
        self.unknown = sp.unk_id()
        self.cache: dict[str, list] = {}

    def _fallback(self, char: str) -> tuple[tuple[int, ...], float]:
        if self.byte[0] == self.unknown:
            return (self.unknown,), self.byte_score
        raw = char.encode()
        return tuple(self.byte[b] for b in raw), len(raw) * self.byte_score

    def word(self, text: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each position, its branches (next position, piece ids, log of the conditional probability)."""
        if text in self.cache:
            return self.cache[text]
        n, get = len(text), self.scan.get
        beta = [0.0] * (n + 1)
        table: list[list] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            edges = []
            for j in range(i + 1, n + 1):
                p = get(text[i:j], False)
                if p:
                    edges.append((j, (p[0],), p[1]))
                elif p is False:
                    break
            if not edges or edges[0][0] != i + 1:
                ids, score = self._fallback(text[i])
                edges.insert(0, (i + 1, ids, score))
            if len(edges) == 1:
                j, ids, s = edges[0]
                beta[i] = s + beta[j]
                table[i] = [(j, ids, 0.0)]
                continue
            mass = [s + beta[j] for j, _, s in edges]
            top = max(mass)
            beta[i] = top + math.log(sum(math.exp(m - top) for m in mass))
            table[i] = [(j, ids, m - beta[i]) for (j, ids, _), m in zip(edges, mass, strict=True)]
        if n <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[text] = table
        return table

    def sample(self, text: str, k: int, key: str) -> list[tuple[list[int], float, float, float]]:
        """Up to k distinct (ids, log_prob, perturbed value, inclusion score), largest perturbed value first."""
        words = self.words.findall(self.sp.normalize(text)) if text else []
        tables = [self.word(w) for w in words]
        uniform, log, exp, log1p = random.Random(key).random, math.log, math.exp, math.log1p
        # Open nodes (value, order, word, position, log prob, path), the best last, at most k + 1 with the leaves.
        gumbel = -log(-log(uniform() or 5e-324))
        open_nodes: list[tuple] = [(gumbel, 0, 0, 0, 0.0, None)]
        leaves: list[tuple] = []
        count, n_words = 1, len(tables)
        while open_nodes and len(leaves) < k:
            value, _, w, i, logp, path = open_nodes.pop()
            room = k + 1 - len(leaves)  # this node and the open ones can still fill so many
            while w < n_words:
                table = tables[w]
                n = len(table)
                while i < n:
                    edges = table[i]
                    if len(edges) == 1:
                        i, ids, _ = edges[0]
                        path = (path, ids)
                        continue
                    draws = [logp + e[2] - log(-log(uniform() or 5e-324)) for e in edges]
                    top = max(draws)
                    best = draws.index(top)
                    floor = open_nodes[0][0] if len(open_nodes) >= room - 1 and open_nodes else -math.inf
                    if room > 1:
                        for e, g in zip(edges, draws, strict=True):
                            if g != top:  # the value of a child given that the largest child has the parent's
                                v = value - g + log1p(-exp(g - top))
                                g = value - max(0.0, v) - log1p(exp(-abs(v)))
                                if g > floor:
                                    count += 1
                                    open_nodes.append((g, count, w, e[0], logp + e[2], (path, e[1])))
                                    open_nodes.sort()
                                    if len(open_nodes) > room - 1:
                                        del open_nodes[0]
                                    floor = open_nodes[0][0] if len(open_nodes) >= room - 1 else -math.inf
                    i, ids, cond = edges[best]
                    logp += cond
                    path = (path, ids)
                w, i = w + 1, 0
            leaves.append((value, logp, path))
        bar = open_nodes[-1][0] if open_nodes else -math.inf  # attained by leaf k + 1
        out = []
        for value, logp, path in leaves:
            parts = []
            while path is not None:
                path, ids = path
                parts.append(ids)
            gap = logp - bar
            inclusion = 1.0 if gap > 700 else -math.expm1(-exp(gap))
            out.append(([x for ids in reversed(parts) for x in ids], logp, value, inclusion))
        return out


def sample_segmentations(rows: DataFrame, model_file: str, key_cols: list[str], text_col: str = "text",
                         samples: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """(key columns, sample, ids, log_prob, perturbed, inclusion): up to ``samples`` rows per row of ``rows``."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key_cols])
    src = rows.select(*key_cols, key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    m = len(key_cols)
    from pyspark.sql.types import StructType, _parse_datatype_string
    extra = "sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
    schema = StructType([*src.schema.fields[:m], *_parse_datatype_string(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_state(("pieces", model_file, alpha), lambda: Lattice(model_file, alpha))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                take, cols = [], ([], [], [], [], [])
                keys, texts = part.column(m), part.column(m + 1)
                for r in range(part.num_rows):
                    for s, found in enumerate(lattice.sample(texts[r].as_py() or "", samples, keys[r].as_py())):
                        take.append(r)
                        for col, x in zip(cols, (s, *found), strict=True):
                            col.append(x)
                index = pa.array(take, pa.int32())
                kinds = (pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(index) for c in range(m)],
                     *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                    [*key_cols, "sample", "ids", "log_prob", "perturbed", "inclusion"])

    return src.mapInArrow(run, schema)


def encode(rows: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``rows`` with the model's own best segmentation as array<int>; a null text stays null."""
    return _added(rows, text_col, ids_col, "array<int>", model_file, lambda sp, x: sp.encode(x))


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of a column of ids; null ids stay null."""
    return _added(rows, ids_col, text_col, "string", model_file, lambda sp, x: sp.decode(x))


def _added(rows: DataFrame, given: str, name: str, kind: str, model_file: str, fn) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    if name in rows.columns:
        raise ValueError(f"column {name} is there already")
    out = _parse_datatype_string(kind)
    at, arrow = rows.columns.index(given), to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for b in batches:
            new = [None if (v := x.as_py()) is None else fn(sp, v) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, arrow)], [*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, out)]))
