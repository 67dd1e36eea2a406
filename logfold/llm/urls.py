"""URL rules by hash prefix, in DataFrame expressions only.

Every distinct (host, path) is expanded once into its host suffixes (at label
ends) and path prefixes (up to each slash, and the empty one), of no more labels
and slashes than the deepest rule has: longer ones fit no rule, so the work is
linear in the address.  A rule is filed under its host and its path up to the
last slash.  Expressions and rules
meet in an equi-join on a short hash prefix; then the full SHA-256 digests are
compared, the rest of the rule's path is matched, and the longest rule wins.

A page's answer depends on (host, path) alone, so pages that share them, such
as one very common address, are combined before the expansion; the answers are
joined back to the pages, where the adaptive join splits a hot address.  The
rule table is joined without a broadcast hint: Spark broadcasts it if it is
small and shuffles it if not.

Defined results: a very long URL is judged whole; a null URL and one without ``://`` have an empty host and
path, which no rule fits; without a fitting rule the verdict is ``default``
and the rule is null.  Rules with a null or empty host, a null path or a null
verdict are ignored; of rules that are equally long the longer host wins, then
``block``.  A null id stays null; repeated rows are
judged alike; an empty table gives no rows, and without rules every verdict is ``default``.  Only the id
and url columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT, prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages``."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    anchor = F.regexp_extract("r_path", r"\A(?:[\s\S]*/)?", 0)
    filed = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"),
                         F.col("verdict").alias("r_verdict"))
    filed = filed.where("r_host <> '' and r_path is not null and r_verdict is not null").distinct()
    filed = filed.withColumn("r_digest", _digest(F.col("r_host"), anchor))
    filed = filed.withColumn("short", F.substring("r_digest", 1, prefix_hex))
    # No rule is filed under more labels or slashes than these two numbers, however long an address is.
    deepest = filed.agg(F.max(F.regexp_count("r_host", F.lit(r"\."))), F.max(F.regexp_count("r_path", F.lit("/")))).first()
    dots, slashes = deepest[0] or 0, deepest[1] or 0

    addresses = parts.select("host", "path").where("host <> ''").distinct().select(
        "host", "path", F.split("host", "\\.", -1).alias("labels"), F.split("path", "/", slashes + 2).alias("steps"))
    suffixes = F.transform(F.sequence(F.greatest(F.size("labels") - dots, F.lit(1)), F.size("labels")),
                           lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size("steps") - 1, F.lit(slashes))),
                           lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("steps", 1, i), "/"), F.lit("/"))))
    expressions = addresses.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select(
        "host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = expressions.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
    expressions = expressions.withColumn("short", F.substring("digest", 1, prefix_hex))

    # Digests confirm the short hash; startswith the part of the rule's path after its last slash.
    hits = expressions.join(filed, "short").where((F.col("digest") == F.col("r_digest")) & F.startswith("path", "r_path"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("host"),
                    (F.col("r_verdict") == "block").alias("block"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
