"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: hashed 1- to 3-grams of the lower-cased letters of the whole text
  (every other character is a space), weight (1 + ln tf) * idf, unit length.
* Document frequencies come from all learning rows, summed by Spark.
* Weights: follow-the-regularised-leader (FTRL-proximal) with elastic-net
  penalties, on a sample of at most ``sample_rows`` labelled rows (a documented
  bound).  Spark counts the languages; each has at least ``sample_rows`` /
  (2 x languages) rows of the sample if it has so many, the rest goes in
  proportion; within a language the hash of id and text chooses, and rows that
  agree in both are one row of the sample, however often they are repeated.  A
  fifth of each language's sample is kept out of the weights and sets the temperature of the
  softmax.  More than ``max_languages`` languages are refused with an error.
* Prediction reads every whole text in an Arrow pass with the broadcast
  weights, whose size is n-gram buckets x languages, both bounded.

Language, source and id are never inputs of a prediction.  Defined results: a
null text and a text without a letter are ``und`` with score 0; without any
learning row every text is ``und``; a null id counts as the empty string for
the fold (held out); rows with a null language are not learned from; repeated
rows are predicted alike and counted in the document frequencies as often as
they occur; of equal scores the first language by code point wins; an empty
table is predicted as no rows.  Further columns are carried by ``keep_known`` and
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.workers import tidy
from logfold.staging import stage

BUCKETS = 1 << 14
SAMPLE_ROWS = 3000
MAX_LANGUAGES = 256
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
MIN_SCORE = 0.4
_CHARS = 1 << 19


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that are never learned from: crc32 of the id's text divisible by ``folds``."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])


class NGrams:
    """Hashed character n-gram counts of a text, in blocks of bounded size."""

    def __init__(self) -> None:
        self.letters = _letter_table()

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(buckets, counts), or None if there is no letter."""
        total, any_letter, carry = None, False, np.zeros(0, np.uint32)
        for lo in range(0, max(len(text), 1), _CHARS):
            c = np.frombuffer(text[lo:lo + _CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            low = self.letters[np.minimum(c, 0xFFFF)]
            if (wide := np.flatnonzero(c > 0xFFFF)).size:
                low[wide] = [chr(x).isalpha() for x in c[wide].tolist()]
            any_letter = any_letter or bool(low.any())
            c = np.concatenate([carry, np.where(low, c, np.uint32(32))])
            skip = carry.size  # grams that end in the carried characters are already counted
            carry = c[-2:]
            g = c * np.uint32(0x9E3779B1)
            parts = [g[skip:]]
            two = g[:-1] * np.uint32(0x85EBCA6B) + g[1:]
            three = two[:-1] * np.uint32(0xC2B2AE35) + g[2:]
            parts += [two[max(skip - 1, 0):] ^ np.uint32(0x27D4EB2F), three[max(skip - 2, 0):] ^ np.uint32(0x165667B1)]
            h = np.concatenate(parts)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            n = np.bincount(h >> np.uint32(32 - 14), minlength=BUCKETS)
            total = n if total is None else total + n
        if not any_letter:
            return None
        ids = np.flatnonzero(total)
        return ids.astype(np.int32), total[ids].astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets + 1) x languages; the last row is the bias
    temperature: float = 1.0

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[ids]
        norm = np.sqrt((x * x).sum()) or 1.0
        return (x / norm) @ self.weights[ids] + self.weights[-1]

    def predict(self, ids: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = _softmax(self.logits(ids, counts) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS,
               alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal weights (buckets + 1, classes) of rows (bucket ids, values, class)."""
    z = np.zeros((BUCKETS + 1, n_classes))
    s = np.zeros_like(z)

    def solve(zi: np.ndarray, si: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, values, y = rows[k]
            i = np.append(ids, BUCKETS)
            x = np.append(values, 1.0)
            zi, si = z[i], s[i]
            w = solve(zi, si)
            err = _softmax(x @ w)
            err[y] -= 1
            g = x[:, None] * err
            grown = si + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(si)) / alpha * w
            s[i] = grown
    return solve(z, s)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Softmax temperature of least log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _quotas(counts: dict[str, int], sample_rows: int) -> dict[str, int]:
    """Sample rows of each language: at least an equal share of half the sample, the rest in proportion."""
    if sum(counts.values()) <= sample_rows:
        return counts
    least = {k: min(n, max(1, sample_rows // (2 * len(counts)))) for k, n in counts.items()}
    rest, more = sample_rows - sum(least.values()), sum(counts.values()) - sum(least.values())
    return {k: least[k] + rest * (n - least[k]) // more for k, n in counts.items()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Learn from the rows outside the held-out fold that have a text and a language; None if there are none.

    ValueError if there are more than ``max_languages`` (or ``sample_rows``) languages.
    """
    learn = docs.where(~held_out(id_col)).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"))
    bound = min(max_languages, sample_rows)
    found = learn.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).limit(bound + 1).collect()
    if not found:
        return None
    if len(found) > bound:
        raise ValueError(f"more than {bound} languages: raise max_languages (and sample_rows, if it is smaller)")
    quotas = _quotas({r.lang: r.n for r in found}, sample_rows)
    # The hash range that holds the quota of a language, with some room; at least its row of the lowest hash.
    share = {r.lang: min(1.0, (quotas[r.lang] + 4 * quotas[r.lang] ** 0.5 + 10) / r.n) for r in found}
    cuts = {r.lang: max(r.low, int(share[r.lang] * (1 << 64)) - (1 << 63)) for r in found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, taken = NGrams(), np.zeros(BUCKETS, np.int64), set()
        kind = pa.list_(pa.int32())
        for b in batches:
            rows = []
            texts, hashes, langs = b.column(2), b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(b.num_rows):
                found = grams.counts(texts[k].as_py())
                if found is not None:
                    df[found[0]] += 1
                    # Repeated rows of a task pass the cut once; those that pass are little more than the sample.
                    if hashes[k] <= cuts[langs[k]] and (langs[k], hashes[k]) not in taken:
                        taken.add((langs[k], hashes[k]))
                        rows.append((langs[k], *found, hashes[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind),
                 pa.array([r[2] for r in rows], kind), pa.nulls(len(rows), pa.int64()),
                 pa.array([r[3] for r in rows], pa.int64())], ["lang", "ids", "counts", "n", "h"])
        # One row a bucket: the documents of this task that hold it.
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(ids.size, pa.string()), pa.array(list(ids[:, None].astype(np.int32)), kind),
             pa.nulls(ids.size, kind), pa.array(df[ids]), pa.nulls(ids.size, pa.int64())], ["lang", "ids", "counts", "n", "h"])

    found = stage(learn.mapInArrow(tidy(run), "lang string, ids array<int>, counts array<int>, n long, h long"), "language-grams")
    # Document frequencies: at most one row a bucket reaches the driver.
    freq = np.zeros(BUCKETS)
    sums = found.where("n is not null").groupBy(F.col("ids")[0].alias("bucket")).agg(F.sum("n").alias("n"))
    for r in sums.collect():
        freq[r.bucket] = r.n
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "ids", "counts"))
    quota = F.element_at(F.create_map(*[F.lit(x) for item in quotas.items() for x in item]), F.col("lang"))
    passed = found.where("lang is not null").dropDuplicates(["lang", "h"])  # at most one row a task of each
    sample = passed.withColumn("rank", rank).where(F.col("rank") <= sample_rows).where(
        F.col("rank") <= quota).collect()  # at most sample_rows x buckets numbers
    languages = sorted({r.lang for r in sample})
    if not languages:
        return None
    n_docs = max(float(freq.max()), 1.0)
    idf = np.log((1 + n_docs) / (1 + freq)) + 1
    rows, tune, n_of = [], [], dict.fromkeys(languages, 0)
    for r in sorted(sample, key=lambda r: (r.lang, r.ids, r.counts)):
        ids, x = np.array(r.ids), (1 + np.log(np.array(r.counts, np.float64)))
        x *= idf[ids]
        n_of[r.lang] += 1
        keep = tune if len(sample) >= 50 and n_of[r.lang] % 5 == 0 else rows  # a language's first rows are always learned from
        keep.append((ids, x / np.sqrt((x * x).sum()), languages.index(r.lang)))
    weights = train_ftrl(rows, len(languages))
    tune = tune or rows
    model = Model(languages, idf, weights)
    logits = np.array([x @ weights[ids] + weights[-1] for ids, x, _ in tune])
    model.temperature = _temperature(logits, np.array([y for _, _, y in tune]))
    return model


def _scores(texts: pa.Array, model: Model | None, grams: NGrams) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for x in texts:
        found = grams.counts(x.as_py()) if model is not None and x.is_valid else None
        lang, score = ("und", 0.0) if found is None else model.predict(*found)
        langs.append(lang)
        scores.append(score)
    return langs, scores


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for b in batches:
            langs, scores = _scores(b.column(2), shared.value, grams)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(tidy(run), "id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for b in batches:
            langs, scores = _scores(b.column(at), shared.value, grams)
            yield b.filter(pa.array([x != "und" and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
