"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

``features`` counts whole texts: words, symbols, repeated lines, and words in
repeated 3-word windows.  Windows are compared by a 64-bit hash inside their
own document (n windows collide with a chance of about n^2 / 2^65).

``fit_thresholds`` turns a labelled holdout into cutoffs.  A rule rejects a
text whose rate exceeds its cutoff.  Cutoffs come from a fixed grid, so the
labels only certify: for each stratum, rule and cutoff, of n good rows (that
pass the base rules) k are rejected; the cutoff passes its test if
P(Binomial(n, a) <= k) <= d, that is if the exact (Clopper-Pearson) upper
bound of the false rejection rate is at most a.  The cutoffs of a rule are
nested, so they are tested in a fixed sequence from the most lenient on, and
all up to the first that fails are certified: the sequence spends its budget d
once.  d is the error budget divided by the sequences (strata x rules,
Bonferroni) and a is the allowed rate divided by the number of rules, so with
confidence 1 - ``error`` the rules together falsely reject at most
``max_false`` of the good texts in every stratum.  Among the certified cutoffs of a rule the one with the largest gain
(bad rows rejected less ``cost`` times good rows rejected) is taken, the most
lenient on ties, and none without a positive gain.  With few labels nothing is
certified and the method keeps every text.

Defined results: a null text has no words; very long texts are counted whole; a
rate equal to a cutoff is kept; an empty table gives no rows; a null label row is ignored and
several labels of one id count as bad if any is; a null stratum is a stratum of
its own; a text with a null id is judged but has no label; repeated rows are
judged alike.  Internal columns are built on narrow projections; ``keep_good``
carries the row as one struct, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.staging import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_FALSE = 0.05
ERROR = 0.05
COST = 20
#: Rules and their cutoffs, lenient last: the rate of each rule is defined in ``_rates``.
GRID = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "marks": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_lines": (0.1, 0.2, 0.3, 0.5),
    "repeats": (0.1, 0.2, 0.3, 0.4),
    "word_length": (8.0, 9.0, 10.0, 12.0),
}
_SPACE = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


def _with_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and the counts of column ``text``.

    Each step names what the next uses several times, so Catalyst evaluates it once.
    """
    body = F.btrim(F.col(text), F.lit(_TRIM))
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep,
        F.when(F.length(body) > 0, F.split(body, _SPACE + "+", -1)).alias("_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("_symbols"),
        F.length(F.regexp_replace(text, r"[^!]+", "")).alias("_marks"),
        lines.alias("_lines"))
    n = F.coalesce(F.size("_words"), F.lit(0))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.select(
        *keep, n.alias("_n"), F.length(F.array_join("_words", "")).alias("_chars"), "_symbols", "_marks",
        F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).alias("_hashes"))
    # Only texts with a repeated window sort their windows.
    repeated = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    df = df.select(
        *keep, "_n", "_chars", "_symbols", "_marks", "_n_lines", "_dup",
        F.when(repeated, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_sorted", j)["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    zero = F.lit(0)
    # Each repeated window covers three words; those an earlier window covers are not counted again.
    covered = F.aggregate(
        at, F.struct(zero.alias("total"), zero.alias("end")),
        lambda s, p: F.struct((s["total"] + p + 3 - F.greatest(p, s["end"])).alias("total"), (p + 3).alias("end")))["total"]
    long = lambda c: F.coalesce(F.col(c), zero).cast("long")
    return df.select(
        *keep, long("_n").alias("n_words"), long("_chars").alias("word_chars"), long("_symbols").alias("n_symbols"),
        long("_marks").alias("n_marks"), F.greatest(long("_n_lines"), zero).alias("n_lines"),
        F.greatest(long("_dup"), zero).alias("n_dup_lines"), F.coalesce(covered, zero).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, counts, base_failed) of every row of ``docs``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                      F.col(text_col).cast("string").alias("_text"))
    return _with_counts(src, "_text", ["id", "stratum"]).withColumn("base_failed", base_failed())


def _rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols": F.col("n_symbols") / words, "marks": F.col("n_marks") / words,
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeats": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words}


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for 0 <= k, summed term by term in logarithms."""
    step = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.lit(0.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.when(i > 0, F.log((n - i + 1) / i) + step).otherwise(F.lit(0.0))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, add)["sum"]


def fit_thresholds(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                   max_false: float = MAX_FALSE, error: float = ERROR, cost: int = COST,
                   grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>): certified cutoffs; strata without one are left out.

    ``feats``: a stored table of ``features``.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg((F.min(label_col) > 0).alias("good"))
    rates = _rates()
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (rates[r] > c).alias("hit"))
                      for r, cutoffs in grid.items() for c in cutoffs])
    counted = stage(
        feats.where("not base_failed").join(known, "id").select("stratum", "good", F.explode(tests).alias("t"))
        .groupBy("stratum", "t.rule", "t.cutoff").agg(
            F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("t.hit")).alias("k"),
            F.count_if(~F.col("good") & F.col("t.hit")).alias("bad")), "quality-tests")
    made = max(counted.select("stratum", "rule").distinct().count(), 1)
    allowed = max_false / len(grid)
    n, k = F.col("n"), F.col("k")
    proven = F.when(k < n * allowed, binomial_cdf(n, k, allowed) <= error / made).otherwise(F.lit(False))
    gain = F.col("bad") - cost * k
    # A window holds the cutoffs of one rule in one stratum, as many as the grid has.
    lenient = Window.partitionBy("stratum", "rule").orderBy(F.col("cutoff").desc())
    certified = counted.withColumn("certified", F.min(proven).over(lenient)).where("certified")
    best = certified.where(gain > 0).groupBy("stratum", "rule").agg(
        F.max(F.struct(gain.alias("gain"), F.col("cutoff").alias("cutoff"))).alias("best"))
    return stage(best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "best.cutoff"))).alias("cutoffs")),
                 "quality-cutoffs")


def judge(feats: DataFrame, thresholds: DataFrame, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """``feats`` with kept: passes the base rules and every certified cutoff of its stratum."""
    t = thresholds.select(F.col("stratum").alias("_stratum"), "cutoffs")
    joined = feats.join(t, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rates = _rates()
    over = F.lit(False)
    for r in grid:
        over = over | F.coalesce(rates[r] > F.try_element_at("cutoffs", F.lit(r)), F.lit(False))
    return joined.select(*feats.columns, (~F.col("base_failed") & ~over).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, counts, base_failed, kept) of every row of ``docs``."""
    feats = stage(features(docs, id_col, text_col, stratum_col), "quality-features")
    return judge(feats, fit_thresholds(feats, labels, id_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, thresholds fitted on the labelled rows of ``docs``."""
    src = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                      F.col(text_col).cast("string").alias("_text"))
    # Written once: a filter on computed counts would be pushed below them and evaluate them again and again.
    marked = stage(_with_counts(src, "_text", ["doc", "id", "stratum"]).withColumn("base_failed", base_failed()), "quality-docs")
    good = judge(marked, fit_thresholds(marked, labels, id_col)).where("kept")
    return good.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
