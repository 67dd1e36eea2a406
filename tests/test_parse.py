"""Row-level parser behaviour (one test per extraction rule)."""

from __future__ import annotations

from datetime import datetime

import pytest

from logfold.sources.tables import entries_from_lines


def parse_one(lines_df, line):
    rows = entries_from_lines(lines_df([line])).collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("2021/11/30 23:59:58,007 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58, 7000)),
        ("30-11-2021 23:59:58 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58)),
        ("2021/11/30 23:59:58 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58)),
        ("2021-11-30 23:59:58,250 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58, 250000)),
        ("2021-11-30T23:59:58.000001 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58, 1)),
        ("2021-11-30T23:59:58-08:00 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58)),
        ("2021-11-30T23:59:58Z DEBUG ends", datetime(2021, 11, 30, 23, 59, 58)),
        ("2021-11-30T23:59:58 DEBUG ends", datetime(2021, 11, 30, 23, 59, 58)),
        ("2024-01-01 10:00:00.1234567 INFO x", None),
        ("2024-02-30 10:00:00 INFO x", None),
        ("2024-01-01 10:00:60 INFO x", None),
        ("0000-01-01 10:00:00 INFO x", None),
        ("x 13/Jun/2026:20:30:54 y", datetime(2026, 6, 13, 20, 30, 54)),
        ("x 13/OCT/2026:20:30:54 y", None),
        ("x 13/oct/2026:20:30:54 y", datetime(2026, 10, 13, 20, 30, 54)),
    ],
)
def test_timestamp_forms(lines_df, line, expected):
    assert parse_one(lines_df, line).timestamp == expected


@pytest.mark.parametrize(
    "line, field, expected",
    [
        ("2021-11-30 23:59:58 WARN queue is long", "level", "WARNING"),
        ("2021-11-30 23:59:58 TRACE enter loop", "level", "TRACE"),
        ("[error] disk gone", "level", "ERROR"),
        ("a trace-id here", "level", "TRACE"),
        ("2021-11-30 23:59:58 INFO [net.shop.Till] open", "logger", "net.shop.Till"),
        ("2021-11-30 23:59:58 INFO [net.shop.Till] open", "message", "open"),
        ("x AuditLogger wrote", "logger", "AuditLogger"),
        ("2021-11-30 23:59:58 INFO request_id=q7-zz ok", "request_id", "q7-zz"),
        ("2021-11-30 23:59:58 INFO trace_id=hop-3 ok", "request_id", "hop-3"),
        ("2021-11-30 23:59:58 INFO session_id=visit8 ok", "request_id", "visit8"),
        ("2021-11-30 23:59:58 INFO 0f9a3c12-77aa-4b0e-9d3c-1234567890ab stored", "request_id",
         "0f9a3c12-77aa-4b0e-9d3c-1234567890ab"),
        ("REQUEST failed", "request_id", "UEST"),
        ("2021-11-30 23:59:58 INFO thread=lane-6 waits", "thread_name", "lane-6"),
        ("2021-11-30 23:59:58 INFO [Thread-88] waits", "thread_name", "Thread-88"),
        ("x [pool-3-thread-7] y", "thread_name", "pool-3-thread-7"),
        ("2021-11-30 23:59:58 INFO Service=StockRoom up", "component", "StockRoom"),
        ("Cache miss for key", "component", "miss"),
        ("x T:T-15-9 y", "trace_id", "T"),
        ("x T:_default_ y", "trace_id", None),
        ("2024-01-01 10:00:00 INFO handled error gracefully", "message", "INFO handled"),
        ("2024-01-01 10:00:00 ERROR Database connection timeout", "message", "ERROR Database connection timeout"),
        ("[x] Information here", "message", "rmation here"),
        ("Caused by: a.b.FooException", "entry_type", "stack_trace"),
        ("\tanything", "entry_type", "stack_trace"),
        ("com.example.FooException: boom", "entry_type", "exception"),
        ("x 3 common frames omitted", "entry_type", "stack_trace"),
        ("  plain text  ", "raw", "plain text"),
    ],
)
def test_field_rules(lines_df, line, field, expected):
    assert getattr(parse_one(lines_df, line), field) == expected


def test_access_line(lines_df):
    r = parse_one(lines_df, '172.16.9.8 - - - 04/Mar/2025:06:07:10 +0200 "PUT /baskets/9 HTTP/1.1" 201 64')
    assert r.entry_type == "access_log"
    assert r.level == "INFO" and r.component == "access_log"
    assert r.message == "PUT /baskets/9 status=201"
    assert r.client_ip == "172.16.9.8" and r.http_status == 201
    assert r.timestamp == datetime(2025, 3, 4, 6, 7, 10)


def test_structured_null_rules(lines_df):
    r = parse_one(lines_df, "[INFO] [2025-03-04 06:07:09,010] [pool-4-lane-3] T:_default_ - R:_default_ "
                            "[NightJob]: idle")
    assert (r.entry_type, r.level, r.logger, r.message) == ("structured", "INFO", "NightJob", "idle")
    assert r.request_id is None and r.trace_id is None
    r = parse_one(lines_df, "[ERROR] [2025-03-04 06:07:09,500] [t1] T:K-1 - R: [CourierLink]")
    assert r.message == "CourierLink" and r.logger is None and r.request_id is None


def test_blank_lines_count_for_numbering(lines_df):
    rows = entries_from_lines(lines_df(["2024-01-01 10:00:00 INFO first", "   ",
                                        "2024-01-01 10:00:01 INFO second"])).collect()
    assert [r.line_number for r in rows] == [1, 3]


def test_context_carry_forward(lines_df):
    path = __import__("pathlib").Path(__file__).parent / "fixtures" / "multiline_service.log"
    lines = path.read_text().splitlines()
    rows = {r.line_number: r for r in entries_from_lines(lines_df(lines)).collect()}
    for n in (2, 3):
        r = rows[n]
        assert (r.level, r.thread_name, r.request_id, r.trace_id, r.logger) == (
            "INFO", "pool-4-lane-9", "ord-5150", "K-7-A", "BasketPlanner")
        assert r.timestamp is None and r.component is None
    assert rows[2].entry_type == "exception" and rows[3].entry_type == "stack_trace"
    assert rows[6].request_id is None and rows[6].trace_id is None
    assert rows[7].request_id is None
    assert rows[8].entry_type == "access_log" and rows[8].http_status == 201


def test_stack_after_error_is_error(lines_df):
    rows = entries_from_lines(lines_df(["2024-01-01 10:00:00 ERROR a", "\tat x.y(Z.java:1)"])).collect()
    assert [r.level for r in rows] == ["ERROR", "ERROR"]


def test_non_ascii_digit_timestamp_is_null(lines_df):
    # Python's strptime matches ASCII digits only, so such a date is no timestamp.
    assert parse_one(lines_df, "٢٠٢٤-٠١-٠١ ١٠:٠٠:٠٠ INFO x").timestamp is None


@pytest.mark.parametrize("zone", ["America/New_York", "UTC"])
def test_iso_text_does_not_depend_on_the_session_zone(spark, zone):
    from datetime import datetime as d

    from pyspark.sql import functions as F

    from logfold.functions.extract import iso_text

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [d(2024, 3, 10, 2, 30), d(2024, 3, 10, 2, 30, 0, 120000), None]
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        assert [r.x for r in df.select(iso_text(F.col("t")).alias("x")).collect()] == [
            "2024-03-10T02:30:00", "2024-03-10T02:30:00.120000", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_null_source_over_several_blocks(spark, monkeypatch):
    from logfold.sources import tables

    monkeypatch.setattr(tables, "BLOCK_LINES", 3)
    lines = ["2024-01-01 10:00:00 ERROR first"] + ["\tat a.b(C.java:1)"] * 9
    df = spark.createDataFrame([(None, i, t) for i, t in enumerate(lines)], "source string, k long, raw_line string")
    rows = sorted(tables.entries_from_lines(df, order="k").collect(), key=lambda r: r.line_number)
    assert [r.line_number for r in rows] == list(range(1, 11)) and {r.level for r in rows} == {"ERROR"}
