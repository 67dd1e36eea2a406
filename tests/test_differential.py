"""Randomised differential test: Spark parse vs the independent DuckDB oracle.

Lines are generated from log-like fragments (timestamps of every shape,
level words in any case, brackets, key=value ids, stack frames, access and
structured shapes, Unicode letters and spaces); both engines parse them and
every field must agree, context carry-forward included.
"""

from __future__ import annotations

import random

import duckdb
import pytest

from logfold.plans import oracle as O
from logfold.sources.tables import entries_from_lines

FRAGMENTS = [
    "2024-01-01 10:00:00", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00.123+05:30", "2024/02/29 23:59:59,5",
    "31-12-2023 00:00:00", "2024-02-30 10:00:00", "2024-01-01 10:00:60", "12/Jun/2024:01:02:03", "12/OCT/2024:01:02:03",
    "INFO", "info", "WARN", "Warning", "ERROR", "error", "FATAL", "critical", "TRACE", "trace-id", "DEBUG",
    "[INFO]", "[main]", "[Thread-7]", "[pool-2-thread-3]", "[com.example.Svc]", "[T-1]", "[]", "[x y]",
    "request_id=r-1", "trace-id: t9", "session_id=s", "REQ-77", "REQUEST", "R:abc", "R:_default_", "T:t-1", "T:_default_",
    "thread=w-2", "thread name: n1", "Service=Pay", "cache miss", "DB: main", "API=v2", "worker: w",
    "550e8400-e29b-41d4-a716-446655440000", "AuditLogger", "timeout", "retry", "connection refused", "shutdown",
    "gc", "memory", "Exception", "java.lang.IllegalStateException: bad", "Caused by: x", "at com.a.B(B.java:1)",
    "3 common frames omitted", "MULTIEXCEPTION", "Überlauf", "数据库", "ſervice=Z", "naïve", "-", ":", "=", "\"",
]
# Dotless i and dotted I are left out: RE2 (the oracle's engine) does not fold
# them to i / I, while Python's case-insensitive matching and the Spark
# expressions do; tests/test_report.py::test_non_ascii_lines covers them.
PREFIXES = ["", "", "", "\t", "   ", "　", " "]
SHAPES = [
    '10.0.0.1 - - - 12/Jun/2024:01:02:03 +0000 "GET /a/b HTTP/1.1" 404 12',
    "[ERROR] [2024-01-01 10:00:00,5] [t-1] T:abc - R:req-1 [Handler]: boom",
    "[warn] [2024-01-01  10:00:00] [dw-1 - x] T:_default_ - R: [Svc]",
]


def _lines(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        if rnd.random() < 0.1:
            out.append(rnd.choice(SHAPES))
            continue
        words = [rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 7))]
        sep = rnd.choice([" ", " ", " ", "  ", "\t"])
        out.append(rnd.choice(PREFIXES) + sep.join(words))
    return out


COLS = ["line_number", "raw", "entry_type", "ts", "level", "logger", "message", "thread_name",
        "component", "request_id", "trace_id", "client_ip", "http_status"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spark_parse_equals_duckdb_oracle(spark, lines_df, seed):
    lines = _lines(600, seed)
    from logfold.functions.extract import iso_text
    from pyspark.sql import functions as F

    got = entries_from_lines(lines_df(lines)).withColumn("ts", iso_text(F.col("timestamp")))
    spark_rows = {r.line_number: tuple(r[c] for c in COLS) for r in got.select(*COLS).collect()}

    con = duckdb.connect()
    con.execute("CREATE TABLE src (source VARCHAR, line_number BIGINT, raw_line VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", [("s", i + 1, t) for i, t in enumerate(lines)])
    sql = (f"WITH lines AS (SELECT * FROM src),\n  {O._parse_ctes()}\n"
           f"SELECT line_number, raw, entry_type, {O.iso('ts_val')} AS ts, level, logger, message, thread_name, "
           f"component, request_id, trace_id, client_ip, http_status FROM entries")
    duck_rows = {r[0]: tuple(r) for r in con.execute(sql).fetchall()}
    assert spark_rows.keys() == duck_rows.keys()
    diffs = [(n, spark_rows[n], duck_rows[n]) for n in sorted(spark_rows) if spark_rows[n] != duck_rows[n]]
    detail = [(n, {c: (a, b) for c, a, b in zip(COLS, s, d) if a != b}) for n, s, d in diffs]
    assert not diffs, detail[:6]


REPORT_FRAGMENTS = [
    "2024-01-0{d} 10:00:0{s} ERROR Database connection timeout",
    "2024-01-0{d} 10:00:0{s} ERROR Database connection timeout for user {n}",
    "2024-01-0{d} 10:00:0{s} CRITICAL disk full on node {n}",
    "2024-01-0{d} 10:00:0{s} WARN Slow response observed",
    "2024-01-0{d} 10:00:0{s} WARNING retry {n} scheduled",
    "2024-01-0{d} 10:00:0{s} INFO Application started",
    "2024-01-0{d} 10:00:0{s} INFO Shutdown initiated",
    "[ERROR] [2024-01-0{d} 10:00:0{s},1] [pool-1-thread-{n}] T:t{n} - R:r{n} [Handler]: Read timed out",
    "com.example.Db{n}Exception: connection reset",
    "\tat com.example.Db.query(Db.java:{n})",
    "GC pause {n} ms, memory usage high",
    "thread pool exhausted Service=Api{n}",
    "",
]


@pytest.mark.parametrize("seed", [11, 12])
def test_report_sections_equal_duckdb_oracle(spark, lines_df, seed):
    from logfold.operators.report import report_sections, report_table

    rnd = random.Random(seed)
    df = None
    rows = []
    for src in ("a", "b", "c", "d"):
        n = rnd.randint(0, 60)
        lines = [rnd.choice(REPORT_FRAGMENTS).format(d=rnd.randint(1, 9), s=rnd.randint(0, 9), n=rnd.randint(0, 3))
                 for _ in range(n)]
        rows += [(src, i + 1, t) for i, t in enumerate(lines)]
        part = lines_df(lines, src)
        df = part if df is None else df.unionByName(part)
    got = sorted(tuple(r) for r in report_sections(report_table(entries_from_lines(df))).collect())

    con = duckdb.connect()
    con.execute("CREATE TABLE src (source VARCHAR, line_number BIGINT, raw_line VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", rows)
    sql = f"WITH lines AS (SELECT * FROM src),\n  {O._parse_ctes()}\n{O.report_sections_sql()}"
    want = sorted(tuple(r) for r in con.execute(sql).fetchall())
    assert got == want


def test_evidence_lines_equal_duckdb_oracle(spark, lines_df):
    from logfold.operators.evidence import evidence_lines

    rnd = random.Random(21)
    df = None
    rows = []
    for src, n in (("big", 400), ("small", 30), ("tiny", 3)):
        lines = [rnd.choice(REPORT_FRAGMENTS).format(d=rnd.randint(1, 9), s=rnd.randint(0, 9), n=rnd.randint(0, 3))
                 for _ in range(n)]
        rows += [(src, i + 1, t) for i, t in enumerate(lines)]
        part = lines_df(lines, src)
        df = part if df is None else df.unionByName(part)
    got = sorted(tuple(r) for r in evidence_lines(entries_from_lines(df)).collect())

    con = duckdb.connect()
    con.execute("CREATE TABLE src (source VARCHAR, line_number BIGINT, raw_line VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", rows)
    sql = f"WITH lines AS (SELECT * FROM src),\n  {O._parse_ctes()}\n{O.EVIDENCE}"
    want = sorted(tuple(r) for r in con.execute(sql).fetchall())
    assert got == want
