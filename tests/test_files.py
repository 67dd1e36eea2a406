"""Text-file source: exact line numbers and context across file blocks.

Invariant: the result does not depend on how Spark splits the files
(``spark.sql.files.maxPartitionBytes``) and equals the table path, which
numbers lines of the same text held in a column.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logfold.plans.analysis import entries_view
from logfold.sources.tables import entries_from_lines
from logfold.sources.text_files import read_log_entries


def _make_log(n: int) -> list[str]:
    out = []
    for i in range(n):
        k = i % 9
        if k == 0:
            out.append(f"2024-01-01 10:{i // 60 % 60:02d}:{i % 60:02d} ERROR Failure {i % 5} request_id=r{i}")
        elif k == 1:
            out.append("com.example.BadThing: oops")
        elif k == 2:
            out.append(f"\tat com.example.X.y(X.java:{i})")
        elif k == 3:
            out.append("")
        elif k == 4:
            out.append(f"[INFO] [2024-01-01 10:00:00,{i % 1000:03d}] [pool-1-thread-{i % 3}] T:t{i} - R:q{i} [Svc]: ok")
        elif k == 5:
            out.append("a\x0cb")  # form feed: two lines for splitlines()
        elif k == 6:
            out.append(f"2024-01-01 10:00:00 WARN thread=w{i} slow")
        else:
            out.append(f"plain {i}")
    return out


def test_block_size_independence(spark, tmp_path, lines_df):
    lines = _make_log(6000)
    f = tmp_path / "big.log"
    f.write_text("\n".join(lines) + "\n")
    cols = ["line_number", "raw", "entry_type", "level", "thread_name", "request_id", "trace_id", "logger", "message"]

    def run(max_bytes):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_bytes))
        try:
            e = entries_view(read_log_entries(spark, str(tmp_path)))
            return sorted(tuple(r) for r in e.select(*cols).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    small = run(16 * 1024)
    large = run(128 * 1024 * 1024)
    assert small == large
    # Same text through the table path (lines split like str.splitlines()).
    text_lines = "\n".join(lines).splitlines()
    t = entries_from_lines(lines_df(text_lines))
    table = sorted(tuple(r) for r in t.select(*cols).collect())
    assert table == small
    assert max(r[0] for r in small) == len(text_lines)


def test_file_blocks_really_split(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(_make_log(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(8 * 1024))
    try:
        from logfold.sources.text_files import read_log_lines

        n_blocks = read_log_lines(spark, str(tmp_path)).select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert n_blocks > 3


def test_extension_filter(spark, tmp_path):
    (tmp_path / "a.LOG").write_text("2024-01-01 10:00:00 INFO a\n")
    (tmp_path / "b.json").write_text("2024-01-01 10:00:00 INFO b\n")
    (tmp_path / "c.txt").write_text("2024-01-01 10:00:00 INFO c\n")
    got = sorted(r.source.rsplit("/", 1)[-1] for r in
                 read_log_entries(spark, str(tmp_path)).select("source").distinct().collect())
    assert got == ["a.LOG", "c.txt"]


def test_invalid_utf8_replaced(spark, tmp_path):
    data = b"2024-01-01 10:00:00 INFO caf\xff\xfe ok \xe2\x82 x \xf0\x9f\x98 y \xed\xa0\x80 z\n"
    (tmp_path / "bad.log").write_bytes(data)
    r = read_log_entries(spark, str(tmp_path)).select(F.col("raw")).first()
    assert r.raw == data.decode("utf-8", errors="replace").strip()


def test_crlf_and_unicode_separators_match_splitlines(spark, tmp_path):
    text = ("2024-01-01 10:00:00 INFO a\r\n\r\n2024-01-01 10:00:01 ERROR b\x0bpart\r\n"
            "line next\x85third\r2024-01-01 10:00:02 WARN c")
    (tmp_path / "x.log").write_bytes(text.encode("utf-8"))
    got = sorted((r.line_number, r.raw) for r in read_log_entries(spark, str(tmp_path)).collect())
    want = [(i + 1, ln.strip()) for i, ln in enumerate(text.splitlines()) if ln.strip()]
    assert got == want


def test_size_filter_and_extension_list(spark, tmp_path):
    from logfold.sources.text_files import extension_glob, parse_extensions

    assert parse_extensions(".LOG, txt,") == (".log", ".txt")
    assert extension_glob([".log"]) == "*.[lL][oO][gG]"
    assert extension_glob([".log", ".txt"]) == "*.{[lL][oO][gG],[tT][xX][tT]}"
    (tmp_path / "small.log").write_text("2024-01-01 10:00:00 INFO a\n")
    (tmp_path / "big.log").write_text("2024-01-01 10:00:00 INFO b\n" * 50000)  # about 1.3 MiB
    got = {r.source.rsplit("/", 1)[-1] for r in
           read_log_entries(spark, str(tmp_path), max_file_size_mb=1).select("source").distinct().collect()}
    assert got == {"small.log"}
    got = {r.source.rsplit("/", 1)[-1] for r in
           read_log_entries(spark, str(tmp_path), extensions=".log,.txt").select("source").distinct().collect()}
    assert got == {"small.log", "big.log"}
