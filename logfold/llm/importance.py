"""Importance resampling towards a target distribution, on hashed word n-grams.

1. An untrained Regex Split of the ``tokenizers`` library pre-tokenises every
   whole ASCII-lowered text into words with offsets.  A feature is a run of 1
   to ``max_words`` consecutive words; it is a window of offset pairs, from the
   first word's start to the last word's end, with every separator run inside
   it read as one space.  Its bucket is the CRC-32 of its UTF-8 bytes modulo
   ``buckets``.  A task works through a text in blocks that end at separators,
   so its memory does not grow with the text's words.
2. A row leaves the task with its own sparse bucket counts; the task's sums
   over all its rows leave as one row, so the corpus histogram is added up
   from one row of at most ``buckets`` numbers per task.
3. A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), from
   its s of S corpus features and t of T target features (B buckets).  The
   vector of B gains is all that reaches the driver.  A document's weight is
   the sum of the gains over its features.
4. The score adds Gumbel noise, floor(-1000 ln(-ln u)), u from a SHA-256 of
   seed and id, to the weight: the highest scores are draws without
   replacement in proportion to exp(weight / 1000).
5. The documents with at least ``min_words`` words are range-sorted by score;
   ranks are the position in the partition plus the rows of earlier ones.

Defined results: a null or wordless text has no features and weight 0; a null
id is hashed as the empty string and comes last among ties; rows equal in score
and id (repeated rows) are ranked one after the other in any order; an empty
corpus gives no rows, an empty target all gains of which floor(1000 ln ...)
follows from T = 0.  Only the id and text columns are read, so further columns
cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.staging import stage

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Characters of a text that are pre-tokenised at a time, and bucket numbers kept per task.
BLOCK_CHARS = 1 << 19
CACHE_FEATURES = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class BucketOf(dict):
    """Buckets by feature, filled on first use and emptied when it holds ``CACHE_FEATURES``."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE_FEATURES:
            self.clear()
        b = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return b


class WordWindows:
    """Feature buckets of texts by a Regex Split and windows of its offset pairs."""

    def __init__(self, max_words: int = MAX_WORDS, buckets: int = BUCKETS):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(_WORD), "removed", invert=True).pre_tokenize_str
        self.max_words, self.bucket = max_words, BucketOf(buckets)

    def blocks(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, block) of the lowered text; a block ends before a separator."""
        lo = 0
        while lo < len(text):
            cut = _GAP.search(text, lo + BLOCK_CHARS)
            hi = cut.start() if cut else len(text)
            yield lo, text[lo:hi].translate(_LOWER)
            lo = hi

    def features(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(words, buckets of the features that end in them) of one block after the other."""
        carry: list[str] = []  # the last words before the block
        for _, block in self.blocks(text):
            found = self.split(block)
            out = [self.bucket[w] for w, _ in found]
            if self.max_words > 1 and found:
                # The carried words stand before the block, so windows across the cut are slices too.
                head = "".join([w + " " for w in carry])
                body = head + block
                spans = [m.span() for m in re.finditer(_WORD, head)] + [(s + len(head), e + len(head)) for _, (s, e) in found]
                for m in range(2, self.max_words + 1):
                    first = max(len(carry) - m + 1, 0)  # windows that end in the block
                    for (s, _), (_, e) in zip(spans[first:], spans[first + m - 1:], strict=False):
                        out.append(self.bucket[_GAP.sub(" ", body[s:e])])
                carry = (carry + [w for w, _ in found[1 - self.max_words:]])[1 - self.max_words:]
            yield len(found), out

    def histogram(self, text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(words, features, buckets, counts) of a whole text."""
        words, total = 0, None
        for n, found in self.features(text):
            ids, counts = np.unique(np.array(found, np.int32), return_counts=True)
            words += n
            if total is None:
                total = ids, counts
            else:  # a further block: add up over all buckets
                dense = np.zeros(self.bucket.buckets, np.int64)
                for i, c in (total, (ids, counts)):
                    dense[i] += c
                total = np.flatnonzero(dense).astype(np.int32), dense[dense > 0]
        ids, counts = total if total is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return words, int(counts.sum()), ids, counts


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *[a.size for a in arrays]])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, max_words: int = MAX_WORDS,
                  buckets: int = BUCKETS) -> DataFrame:
    """Stored (doc_id, n_words, n_features, buckets, counts, total): a row per document, and a ``total`` row per task."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_features", "buckets", "counts", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, sums = WordWindows(max_words, buckets), np.zeros(buckets, np.int64)

        def rows(ids: pa.Array, found: list[tuple], total: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()),
                 _lists([r[2] for r in found], pa.int32()), _lists([r[3] for r in found], pa.int64()),
                 pa.array([total] * len(found), pa.bool_())], names)

        for b in batches:
            for part in (b.slice(lo, 1000) for lo in range(0, b.num_rows, 1000)):
                found = [windows.histogram(x.as_py() or "") for x in part.column(1)]
                for _, _, ids, counts in found:
                    sums[ids] += counts
                yield rows(part.column(0), found, False)
        ids = np.flatnonzero(sums)
        yield rows(pa.nulls(1, pa.int64()), [(0, int(sums.sum()), ids.astype(np.int32), sums[ids])], True)

    return stage(src.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>, "
                                     "total boolean"), "importance-counts")


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents by bucket: at most ``buckets`` rows reach the driver."""
    pairs = counted.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    out = np.zeros(buckets, np.int64)
    for r in pairs.groupBy("x.buckets").agg(F.sum("x.counts").alias("n")).collect():
        out[r.buckets] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket from the two histograms."""
    size, s_all, t_all = corpus.size, float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (s_all + size) / ((corpus + 1.0) * (t_all + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            ends = np.cumsum(np.concatenate([[0], b.column(3).value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64)
            run_sum = np.concatenate([[0], np.cumsum(shared.value[ids] * n)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(run_sum[ends[1:]] - run_sum[ends[:-1]], pa.int64())],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return counted.where("not total").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of SHA-256(``seed:id``)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with the rank of the drawn rows, null for the others."""
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "importance-scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The row number splits even rows that agree in score and id between partitions.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = stage(able.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()),
                   "importance-sorted")
    # One row a partition: a bounded table, its running sum on the driver, sent back as a small broadcast.
    parts = sorted(ranged.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect())
    start, before = [], 0
    for p in parts:
        start.append((p.part, before + 1 - p.first))
        before += p.n
    spans = scored.sparkSession.createDataFrame(start, "part int, shift long")
    placed = ranged.join(F.broadcast(spans), "part").withColumn("at", F.col("at") + F.col("shift"))
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = placed.select(*cols, F.when(F.col("at") <= drawn, F.col("at")).alias("rank"))
    return ranked.unionAll(scored.where(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_id: str = "item_id", target_text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per document; rank is null for those not drawn."""
    counted = bucket_counts(docs, id_col, text_col, max_words, buckets)
    aim = bucket_counts(target, target_id, target_text, max_words, buckets)
    scored = weights(counted, gains(histogram(counted, buckets), histogram(aim, buckets)))
    return draw(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), min_words, percent)
