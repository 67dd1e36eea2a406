"""Golden heuristic report for the six-line incident fixture, and the empty case."""

from __future__ import annotations

import json
import shutil

from pyspark.sql import functions as F

from logfold.operators import aggregates as A
from logfold.operators.evidence import evidence_lines
from logfold.plans.analysis import analyze_files, result_json
from logfold.sources.admission import admission_audit

from log_fixtures import FIXTURES


def _reports(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    shutil.copy(FIXTURES / "sample_incident.log", d / "sample_incident.log")
    (d / "empty.log").write_text("")
    res = analyze_files(spark, str(d))
    return {r.source.rsplit("/", 1)[-1]: json.loads(r.json) for r in result_json(res).collect()}


def test_golden_report(spark, tmp_path):
    reports = _reports(spark, tmp_path)
    r = reports["sample_incident.log"]
    assert r["executive_summary"] == (
        "The log contains 6 parsed line(s) with levels ERROR, INFO, WARNING. "
        "Time range: 2024-01-01T10:00:00 -> 2024-01-01T10:00:15. "
        "Execution appears degraded with 2 error occurrence(s) and 1 warning occurrence(s). "
        "Primary issue: ERROR Database connection timeout."
    )
    ov = r["log_overview"]
    assert ov["time_range"] == "2024-01-01T10:00:00 -> 2024-01-01T10:00:15"
    assert ov["total_lines_processed"] == 6
    assert ov["log_levels_observed"] == ["ERROR", "INFO", "WARNING"]
    assert ov["major_components"] == [] and ov["request_identifiers"] == [] and ov["thread_names"] == []
    assert r["timeline"] == [
        {"timestamp": "2024-01-01T10:00:05", "message": "WARN Slow response observed", "source": "WARNING"},
        {"timestamp": "2024-01-01T10:00:10", "message": "ERROR Database connection timeout", "source": "ERROR"},
        {"timestamp": "2024-01-01T10:00:10", "message": "ERROR Database connection timeout", "source": "ERROR"},
    ]
    assert r["error_analysis"] == [{
        "error_type": "ERROR Database connection timeout", "occurrence_count": 2,
        "first_occurrence": "2024-01-01T10:00:10", "last_occurrence": "2024-01-01T10:00:10",
        "short_explanation": "Repeated error condition observed in logs.",
    }]
    assert r["warning_analysis"][0]["occurrence_count"] == 1
    assert r["pattern_detection"] == [
        "2 error events detected.", "1 warning events detected.", "Timeout-related messages were observed.",
        "Timeout loop signatures were found.", "Connection-related issues appear in the logs.",
    ]
    assert r["anomalies"] == [
        "Warnings preceded or accompanied error activity.", "Shutdown-related events were detected.",
        "Unexpected shutdown or termination was observed.",
    ]
    lrc = r["likely_root_cause"]
    assert lrc["observed_facts"] == [
        "ERROR Database connection timeout occurred 2 time(s) between 2024-01-01T10:00:10 and 2024-01-01T10:00:10.",
        "Timeout loop signatures were found.", "Connection-related issues appear in the logs.",
        "Unexpected shutdown or termination was observed.",
    ]
    assert lrc["possible_causes"] == [
        "Downstream dependency latency or network timeout.",
        "Connectivity issue between services or to infrastructure.",
    ]
    assert lrc["assumptions"] == []
    assert len(r["recommendations"]) == 4
    assert r["interesting_log_snippets"] == ["2024-01-01 10:00:10 ERROR Database connection timeout"]
    assert r["analysis_source"] == "static_fallback" and "llm_error" not in r


def test_empty_file_report(spark, tmp_path):
    r = _reports(spark, tmp_path)["empty.log"]
    assert r["executive_summary"] == "No log entries were found. The file may be empty or unparsable."
    assert r["log_overview"]["total_lines_processed"] == 0 and r["log_overview"]["time_range"] is None
    assert r["likely_root_cause"]["assumptions"] == [
        "No strong failure signals were detected; health assessment is based on limited evidence."]
    assert r["recommendations"] == [
        "Collect additional logs around the reported time range if behavior remains unclear."]
    assert r["timeline"] == [] and r["error_analysis"] == [] and r["pattern_detection"] == []


def test_statistics_and_evidence(spark, lines_df):
    from logfold.sources.tables import entries_from_lines

    e = entries_from_lines(lines_df((FIXTURES / "sample_incident.log").read_text().splitlines()))
    stats = {(r.dimension, r.value): (r.n, r.rank) for r in A.statistics(e).collect()}
    assert stats == {("levels", "INFO"): (3, 1), ("levels", "WARNING"): (1, 2), ("levels", "ERROR"): (2, 3)}
    ev = evidence_lines(e)
    counts = {r.section: r["count"] for r in ev.groupBy("section").count().collect()}
    assert counts == {"error_lines": 2, "warning_lines": 1, "lifecycle_lines": 5, "sample_lines": 5}
    first = ev.filter(F.col("section") == "error_lines").orderBy("rank").first()
    assert first.line == "[2024-01-01T10:00:10] ERROR 2024-01-01 10:00:10 ERROR Database connection timeout"


def test_top_values_cap_and_ties(spark, lines_df):
    from logfold.sources.tables import entries_from_lines

    lines = [f"x Service=C{i:02d} thread=main" for i in range(14)] + ["x Service=C05"]
    e = entries_from_lines(lines_df(lines))
    top = A.top_values(e).filter(F.col("dimension") == "components").orderBy("rank").collect()
    assert len(top) == 10
    assert top[0].value == "C05" and top[0].n == 2
    assert [t.value for t in top[1:4]] == ["C00", "C01", "C02"]
    fv = A.first_values(e).filter(F.col("dimension") == "component").orderBy("rank").collect()
    assert [r.value for r in fv] == [f"C{i:02d}" for i in range(10)]


def test_admission_audit(spark, tmp_path):
    (tmp_path / "a.LOG").write_text("x\n")
    (tmp_path / "b.json").write_text("{}\n")
    (tmp_path / "big.txt").write_bytes(b"y" * (2 * 1024 * 1024))
    (tmp_path / "bad.log").write_bytes(b"\xff\xfe broken\n")
    audit = {r.path.rsplit("/", 1)[-1]: r.status for r in
             admission_audit(spark, [str(tmp_path), str(tmp_path / "missing.log")], max_file_size_mb=1).collect()}
    assert audit == {"a.LOG": "admitted", "b.json": "rejected", "big.txt": "rejected", "bad.log": "admitted",
                     "missing.log": "missing"}


def test_multi_source_equals_single_sources(spark, lines_df):
    """A report computed for many sources at once equals each source computed alone."""
    from logfold.operators.report import report_sections, report_table
    from logfold.sources.tables import entries_from_lines

    a = (FIXTURES / "sample_incident.log").read_text().splitlines()
    b = (FIXTURES / "multiline_service.log").read_text().splitlines()
    both = lines_df(a, "a").unionByName(lines_df(b, "b"))

    def sections(df):
        return sorted(tuple(r) for r in report_sections(report_table(entries_from_lines(df))).collect())

    assert sections(both) == sorted(sections(lines_df(a, "a")) + sections(lines_df(b, "b")))


def test_clean_log_has_no_connection_anomaly(spark, lines_df):
    from logfold.operators.aggregates import source_summary
    from logfold.operators.report import signal_columns
    from logfold.sources.tables import entries_from_lines

    s = signal_columns(source_summary(entries_from_lines(
        lines_df(["2024-01-01 10:00:00 INFO Healthy heartbeat"])))).first()
    assert s.pattern_detection == [] and s.anomalies == []


def test_non_ascii_lines(spark, lines_df):
    from logfold.sources.tables import entries_from_lines

    r = entries_from_lines(lines_df(["2024-01-01 10:00:00 ERROR Überlauf 数据库 ıNFO ſervice=Zahlung"])).first()
    assert r.level == "ERROR"
    assert r.component == "Zahlung"  # 'ſervice' matches Service case-insensitively
    # dotless i matches I case-insensitively, so the message is cut at " ıNFO"
    assert r.message == "ERROR Überlauf 数据库"


def test_nest_limit_keeps_counts_whole(spark, lines_df):
    from logfold.operators.report import report_table
    from logfold.sources.tables import entries_from_lines

    lines = [f"2024-01-01 10:00:00 ERROR failure kind {i % 7}" for i in range(50)]
    r = report_table(entries_from_lines(lines_df(lines)), nest_limit=3).first()
    assert len(r.error_analysis) == 3 and r.error_group_count == 7 and r.error_occurrences == 50
    assert [g.occurrence_count for g in r.error_analysis] == [8, 7, 7]


def test_every_group_is_in_the_report(spark, lines_df):
    from logfold.operators.report import report_table
    from logfold.sources.tables import entries_from_lines

    lines = [f"2024-01-01 10:00:00 ERROR failure number x{i}y" for i in range(1500)]
    r = report_table(entries_from_lines(lines_df(lines))).first()
    assert len(r.error_analysis) == r.error_group_count > 1000


def test_audit_agrees_with_the_scan(spark, tmp_path):
    """Globs, hidden folders, zero-length files and suffixes: the audit admits what the scan reads."""
    from logfold.sources.text_files import read_log_entries

    line = "2024-01-01 10:00:00 ERROR boom\n"
    for name in ("a.log", "b.LOG", "sub/c.log", "_temporary/h.log", ".hid/h.log", "x.log.gz", "odd [1].log"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(line)
    (tmp_path / "x.log.gz").unlink()
    (tmp_path / "notes.md").write_text("x")
    (tmp_path / "empty.log").write_text("")
    audit = admission_audit(spark, str(tmp_path)).collect()
    admitted = {r.path for r in audit if r.status == "admitted"}
    read = {r.source for r in read_log_entries(spark, str(tmp_path)).select("source").distinct().collect()}
    assert admitted == read | {p for p in admitted if p.endswith("/empty.log")} and len(admitted) == 5
    assert {(r.path.rsplit("/", 1)[-1], r.status, r.reason) for r in audit if r.status != "admitted"} == {
        ("notes.md", "rejected", "unsupported file type '.md'")}
    reports = analyze_files(spark, [f"{tmp_path}/*.log", f"{tmp_path}/none-*.log"]).select("source", "executive_summary").collect()
    assert sorted(r.source.rsplit("/", 1)[-1] for r in reports) == ["a.log", "empty.log", "odd%20%5B1%5D.log"]
    gone = admission_audit(spark, [f"{tmp_path}/none-*.log"]).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.status) for r in gone] == [("none-*.log", "missing")]


def test_null_source_has_a_whole_report(spark, lines_df):
    from pyspark.sql import functions as F

    from logfold.operators.report import report_sections, report_table
    from logfold.sources.tables import entries_from_lines

    lines = (FIXTURES / "sample_incident.log").read_text().splitlines()
    named = report_table(entries_from_lines(lines_df(lines, "a")))
    unnamed = report_table(entries_from_lines(lines_df(lines, "a").withColumn("source", F.lit(None).cast("string"))))
    assert [tuple(r)[1:] for r in unnamed.collect()] == [tuple(r)[1:] for r in named.collect()]
    assert report_sections(unnamed).count() == report_sections(named).count() > 0


def test_short_labels_match_in_every_block(spark, lines_df, monkeypatch):
    """A short label that begins longer messages: the first entry wins, however the groups are cut."""
    import logfold.operators.snippets as S
    from logfold.sources.tables import entries_from_lines

    lines = [f"2024-01-01 10:00:0{i % 10} ERROR boom{'' if i >= 7 else f' early {i}'}" for i in range(12)]
    entries = entries_from_lines(lines_df(lines))
    want = [tuple(r) for r in S.snippets(entries).orderBy("rank").collect()]
    assert want[0][2] == lines[0]
    monkeypatch.setattr(S, "SNIPPET_BLOCK", 2)
    assert [tuple(r) for r in S.snippets(entries).orderBy("rank").collect()] == want
