"""Command line: printed reports, written reports, exit codes."""

from __future__ import annotations

import json
import shutil

from logfold.__main__ import main

from log_fixtures import FIXTURES


def test_cli_prints_reports(spark, tmp_path, capsys):
    shutil.copy(FIXTURES / "sample_incident.log", tmp_path / "a.log")
    (tmp_path / "notes.json").write_text("{}")
    assert main([str(tmp_path), str(tmp_path / "missing.log")]) == 0
    out = capsys.readouterr()
    report = json.loads(out.out)
    assert report["source"].endswith("a.log") and report["analysis_source"] == "static_fallback"
    assert "notes.json: rejected" in out.err and "missing.log: missing" in out.err


def test_cli_writes_and_fails_without_input(spark, tmp_path):
    shutil.copy(FIXTURES / "sample_incident.log", tmp_path / "a.log")
    out_dir = tmp_path / "out"
    assert main([str(tmp_path / "a.log"), "--out", str(out_dir)]) == 0
    assert len(spark.read.text(str(out_dir)).collect()) == 1
    assert main([str(tmp_path / "nothing.log")]) == 1
