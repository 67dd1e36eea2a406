"""File-arrival reports through Structured Streaming."""

from __future__ import annotations

import json
import shutil

from logfold.streaming.files import start_file_reports

from log_fixtures import FIXTURES


def test_stream_reports_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(FIXTURES / "sample_incident.log", src / "a.log")
    shutil.copy(FIXTURES / "multiline_service.log", src / "b.log")
    out = tmp_path / "out"
    q = start_file_reports(spark, str(src), str(out), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(300)
    rows = [json.loads(r.value) for r in spark.read.text(str(out)).collect()]
    by = {r["source"].rsplit("/", 1)[-1]: r for r in rows}
    assert set(by) == {"a.log", "b.log"}
    assert by["a.log"]["log_overview"]["total_lines_processed"] == 6
    assert by["b.log"]["log_overview"]["total_lines_processed"] == 8
    # A second run with the same checkpoint finds nothing new.
    q = start_file_reports(spark, str(src), str(out), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(300)
    assert spark.read.text(str(out)).count() == 2


def test_progress_outlives_cleared_staging(spark, tmp_path):
    from logfold.staging import clear_staged

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(FIXTURES / "sample_incident.log", src / "a.log")
    out = str(tmp_path / "out")
    for _ in range(2):
        start_file_reports(spark, str(src), out, available_now=True).awaitTermination(300)
        clear_staged(spark)
        assert spark.read.text(out).count() == 1
