"""Secret scan with corpus-wide ownership frequency.

Pass 1 (Arrow, whole texts) finds the base spans (assignments, access keys,
hexadecimal keys) and further candidates: 20 or more key characters in a row
with letters and digits and high entropy, where the base spans end a run (what
a maximal run has before, between and after them are candidates of their own).
Every candidate and base value is hashed.  The hashes are aggregated over the
corpus by distinct owners and distinct repositories, each in two map-side
combined groupings, so a value copied into a third of all rows is reduced
before any shuffle.  A value with more than ``max_owners`` owners, or in more
than ``max_repos`` repositories, is a widely copied example; the rest are
owner-specific and look live.  Base spans always stay; a further candidate
becomes a span (kind ``entropy``) only if it is owner-specific.  Both counts of
every value are returned beside its place (``ownership``).

Defined results: a null text is empty and has no spans; an empty span list
gives the hash of the empty string; null owners or repositories count as one
owner or repository; a null id stays null; repeated rows are scanned alike and
count once in the ownership.  ``redact`` carries all columns whole; internal
names cannot clash because the row travels as one struct.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.workers import tidy
from logfold.staging import stage

KINDS = ("assign", "access", "hex", "entropy")
MAX_OWNERS = 2
#: A live value may occur in some versions and files of its owner; above this it is an example that one owner repeats.
MAX_REPOS = 100
MIN_ENTROPY = 3.5
MIN_RUN = 20
MASK = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # equals dropping maximal runs of fewer than 24
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}")
_WORDS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind number, end, value) of the base kinds, by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Key-like runs, cut at the base spans, in the same form."""
    out, k = [], 0
    by_start = sorted((s, e) for s, _, e, _ in base)
    reach = 0  # end of the base spans so far
    for m in _RUN.finditer(text):
        parts, at = [], m.start()
        while k < len(by_start) and by_start[k][0] < m.end():
            at = max(at, reach)
            parts.append((at, by_start[k][0]))
            reach = max(reach, by_start[k][1])
            k += 1
        for start, end in [*parts, (max(at, reach), m.end())]:
            v = text[start:end]
            if end - start >= MIN_RUN and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and _entropy(v) >= MIN_ENTROPY:
                out.append((start, 3, end, v))
    return out


_SPAN = "struct<start:int,kind:int,end:int,hash:binary>"


def _scan_column(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))

    def rows(spans: list[tuple[int, int, int, str]]) -> list[dict]:
        return [{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).digest()} for s, k, e, v in spans]

    base, more = [], []
    for x in texts:
        text = x.as_py() or ""
        spans = base_spans(text)
        base.append(rows(spans))
        more.append(rows(candidates(text, spans)))
    return pa.array(base, kind), pa.array(more, kind)


def _scanned(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep columns, owner, repo, base and more (span lists) of every row, with a row number; staged."""
    src = docs.select(*keep, F.col(text_col).cast("string").alias("_scan_text"))
    names = src.columns[:-1]
    from pyspark.sql.types import StructType, _parse_datatype_string
    schema = StructType([*src.schema.fields[:-1], *_parse_datatype_string(f"base array<{_SPAN}>, more array<{_SPAN}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = _scan_column(b.column(len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], base, more], [*names, "base", "more"])

    return stage(src.mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id()), "secrets-scan")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories of every candidate value of the corpus."""
    values = scanned.where((F.size("base") > 0) | (F.size("more") > 0)).select(
        F.explode(F.concat("base", "more")).alias("s"), "owner", "repo").select("s.hash", "owner", "repo")
    owners = values.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repos = values.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    return owners.join(repos, "hash")


def _judged(scanned: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(row, live_more, counted, n_live, n_example) of the rows that hold any value."""
    some = scanned.where((F.size("base") > 0) | (F.size("more") > 0))
    values = some.select("row", F.explode(F.concat("base", "more")).alias("s"))
    freq = stage(ownership(scanned), "secrets-owners")
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    return values.select("row", "s", F.col("s.hash").alias("hash")).join(freq, "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(live & (F.col("s.kind") == 3), F.struct("s.start", "s.kind", "s.end")))).alias("live_more"),
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "owners", "repos"))).alias("counted"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"))


def _merged() -> Column:
    """All spans of a row, by start, then kind."""
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.array_sort(F.concat(base, F.coalesce("live_more", none)))


def _text(spans: Column, *further: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), *[s[c].cast("string") for c in ("start", "end", *further)])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_spans, spans, ownership, n_live, n_example) of every row.

    ``ownership`` has every base value and candidate as kind:start:end:owners:repositories.
    """
    scanned = _scanned(docs, text_col, [F.col(id_col).cast("long").alias("id"), F.col(owner_col).cast("string").alias("owner"),
                                        F.col(repo_col).cast("string").alias("repo")])
    done = scanned.join(_judged(scanned, max_owners, max_repos), "row", "left")
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return done.select("id", *count, _text(F.col("base")).alias("base_spans"), _text(_merged()).alias("spans"),
                       F.coalesce(_text(F.col("counted"), "owners", "repos"), F.lit("")).alias("ownership"),
                       F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with every span (overlapping ones together) replaced by the mask."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
           length_col: str | None = "n_chars", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``docs`` with every span masked in the text; ``length_col`` (if there is one) follows the new text."""
    scanned = _scanned(docs, text_col, [
        F.struct("*").alias("doc"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo")])
    judged = _judged(scanned, max_owners, max_repos).where(F.size("live_more") > 0).select("row", "live_more")
    # Only rows with a further candidate can gain spans; the others keep their base spans.
    open_rows = scanned.where(F.size("more") > 0).join(judged, "row", "left").select("doc", _merged().alias("spans"))
    rest = scanned.where(F.size("more") == 0).withColumn("live_more", F.lit(None)).select("doc", _merged().alias("spans"))
    masked = open_rows.unionAll(rest).select("doc", F.col("doc").getField(text_col).cast("string").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(1), b.column(2)
            new = [None if not (x := texts[k]).is_valid else x.as_py() if not len(spans[k])
                   else mask(x.as_py(), [(s["start"], s["end"]) for s in spans[k].as_py()]) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["doc", "text"])

    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([masked.schema["doc"], StructField("text", StringType())])
    done = masked.mapInArrow(tidy(run), schema)
    kind = docs.schema
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("text").cast(kind[c].dataType).alias(c))
        elif c == length_col:
            cols.append(F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind[c].dataType))
                        .otherwise(F.col("doc").getField(c)).alias(c))
        else:
            cols.append(F.col("doc").getField(c).alias(c))
    return done.select(*cols)
