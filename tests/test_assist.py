"""Model-assisted path: evidence, prompt, completion with stub clients, checking, choice."""

from __future__ import annotations

import json

from logfold.operators.assist import check_responses, evidence_bundle
from logfold.plans.analysis import analyze_with_model, result_json
from logfold.sources.tables import entries_from_lines

from log_fixtures import FIXTURES

VALID = {
    "executive_summary": "Model summary.",
    "log_overview": {"time_range": None, "total_lines_processed": "6", "log_levels_observed": ["ERROR"]},
    "timeline": [{"timestamp": None, "message": "m", "source": "ERROR"}],
    "error_analysis": [{"error_type": "E", "occurrence_count": 2.0}],
    "unknown_field": 1,
}


def _entries(lines_df):
    return entries_from_lines(lines_df((FIXTURES / "sample_incident.log").read_text().splitlines()))


def test_check_responses_rules(spark):
    deep = "[" * 50_000
    replies = {
        "fenced": "noise\n```json\n" + json.dumps(VALID) + "\n```",
        "plain": json.dumps(VALID),
        "words": "not json",
        "list": "[1]",
        "partial": '{"executive_summary": "x"}',
        "null_list": json.dumps(dict(VALID, timeline=None)),
        "bad_item": json.dumps(dict(VALID, timeline=[{"timestamp": "t"}])),
        "deep": '{"executive_summary": ' + deep,
        "digits": '{"executive_summary": ' + "9" * 5000 + "}",
        "decimal": json.dumps(dict(VALID, log_overview={"total_lines_processed": "5.0"})),
        "half": json.dumps(dict(VALID, log_overview={"total_lines_processed": "5.5"})),
        "none": None,
    }
    df = spark.createDataFrame([(k, v, None) for k, v in replies.items()] + [("failed", None, "TimeoutError: slow")],
                               "source string, response string, error string")
    got = {r.source: r for r in check_responses(df).collect()}
    for k in ("fenced", "plain"):
        rep = got[k].report
        assert got[k].llm_error is None and rep.log_overview.total_lines_processed == 6
        assert rep.error_analysis[0].occurrence_count == 2 and rep.error_analysis[0].short_explanation == ""
        assert rep.likely_root_cause.asDict() == {"observed_facts": [], "possible_causes": [], "assumptions": []}
    assert got["words"].llm_error.startswith("LLM returned invalid JSON")
    assert got["list"].llm_error == "LLM response must be a JSON object."
    assert "log_overview" in got["partial"].llm_error
    assert got["null_list"].llm_error.startswith("Report validation failed")
    assert "message" in got["bad_item"].llm_error
    assert got["deep"].llm_error and got["digits"].llm_error and got["none"].llm_error == "Model returned no content."
    assert got["decimal"].report.log_overview.total_lines_processed == 5
    assert got["half"].llm_error.startswith("Report validation failed")
    assert got["failed"].report is None and got["failed"].llm_error == "TimeoutError: slow"


def test_evidence_bundle_shape(spark, lines_df):
    b = evidence_bundle(_entries(lines_df)).first().evidence
    assert b.total_lines == 6 and b.time_range == "2024-01-01T10:00:00 -> 2024-01-01T10:00:15"
    assert b.statistics.levels == {"INFO": 3, "WARNING": 1, "ERROR": 2}
    assert len(b.error_lines) == 2 and len(b.warning_lines) == 1 and len(b.lifecycle_lines) == 5
    assert len(b.sample_lines) == 5


def _run(spark, lines_df, client_cls):
    res = analyze_with_model(_entries(lines_df), client_cls)
    return json.loads(result_json(res).first().json)


def test_model_report_used_when_valid(spark, lines_df):
    payload = json.dumps(VALID)

    class Good:
        def generate(self, prompt):
            assert "Evidence bundle:" in prompt and "JSON schema:" in prompt
            return payload

    r = _run(spark, lines_df, Good)
    assert r["analysis_source"] == "llm" and "llm_error" not in r
    assert r["executive_summary"] == "Model summary."


def test_fallback_on_client_error_and_bad_output(spark, lines_df):
    class Failing:
        def generate(self, prompt):
            raise RuntimeError("upstream unavailable")

    class Wrong:
        def generate(self, prompt):
            return '{"executive_summary": "only"}'

    for cls, needle in ((Failing, "upstream unavailable"), (Wrong, "log_overview")):
        r = _run(spark, lines_df, cls)
        assert r["analysis_source"] == "static_fallback"
        assert needle in r["llm_error"]
        assert r["executive_summary"].startswith("The log contains 6 parsed line(s)")


def test_disabled_model_step(spark, lines_df):
    r = _run(spark, lines_df, None)
    assert r["analysis_source"] == "static_fallback" and "llm_error" not in r


def test_prompts_contain_rules_schema_and_evidence(spark, lines_df):
    from logfold.operators.assist import analysis_prompt, refinement_prompt
    from logfold.plans.analysis import static_result

    e = _entries(lines_df)
    p = analysis_prompt(evidence_bundle(e)).first().prompt
    assert p.startswith("You are an on-call log analysis agent.\nAnalyze ONLY the evidence below")
    assert "- Return valid JSON only, matching the schema exactly." in p
    schema = p.split("JSON schema:\n", 1)[1].split("\n\nEvidence bundle:\n", 1)[0]
    assert json.loads(schema)["log_overview"]["total_lines_processed"] == "integer"
    evidence = json.loads(p.split("Evidence bundle:\n", 1)[1])
    assert evidence["total_lines"] == 6 and len(evidence["error_lines"]) == 2
    r = refinement_prompt(static_result(e)).first().prompt
    assert r.startswith("Refine this structured log analysis report")
    assert json.loads(r.split("Report:\n", 1)[1])["log_overview"]["total_lines_processed"] == 6


def test_concurrent_completion_keeps_order(spark):
    from logfold.operators.assist import complete

    class Echo:
        def generate(self, prompt):
            if prompt.endswith("7"):
                raise ValueError("bad seven")
            return prompt.upper()

    prompts = spark.createDataFrame([(f"s{i}", f"p{i}") for i in range(40)], "source string, prompt string")
    rows = {r.source: (r.response, r.error) for r in complete(prompts.repartition(3), Echo, concurrency=4).collect()}
    assert rows["s3"] == ("P3", None)
    assert rows["s17"] == (None, "ValueError: bad seven")
    assert len(rows) == 40


def test_prompts_equal_the_plain_encoding(spark, lines_df):
    """The prompts' JSON is what Python's encoder writes, escapes included."""
    from logfold.functions import patterns as P
    from logfold.operators.assist import REPORT_FIELDS, analysis_prompt, refinement_prompt
    from logfold.plans.analysis import static_result

    odd = ['2024-01-01 10:00:00 ERROR caf\u00e9 "down" C:\\x \U0001F600', "2024-01-01 10:00:01 WARN tab\there\x7f"]
    e = entries_from_lines(lines_df((FIXTURES / "sample_incident.log").read_text().splitlines() + odd))
    bundle = evidence_bundle(e)
    b = bundle.first().evidence.asDict(recursive=True)
    head = P.ANALYSIS_PROMPT_HEAD + P.ANALYSIS_RULES + "\n\nJSON schema:\n" + json.dumps(P.REPORT_SCHEMA_TEXT, indent=2)
    assert analysis_prompt(bundle).first().prompt == head + "\n\nEvidence bundle:\n" + json.dumps(b, indent=2)
    report = static_result(e)
    d = {k: v for k, v in report.first().asDict(recursive=True).items() if k in REPORT_FIELDS}
    assert refinement_prompt(report).first().prompt == P.REFINEMENT_PROMPT_HEAD + "Report:\n" + json.dumps(d, indent=2)


def _counting(folder):
    """A client that leaves one file per call in a folder that all tasks of a local session share."""
    folder = str(folder)

    class Counting:
        def generate(self, prompt):
            import uuid
            from pathlib import Path

            (Path(folder) / uuid.uuid4().hex).write_text(self.system_prompt)
            if "fail" in prompt:
                raise TimeoutError("slow")
            return prompt.upper()

    return Counting


def test_each_prompt_is_asked_once(spark, tmp_path):
    from logfold.functions import patterns as P
    from logfold.operators.assist import stored_replies

    calls, table = tmp_path / "calls", str(tmp_path / "replies")
    calls.mkdir()
    rows = [("a", "p1"), ("b", "p1"), ("c", "p2"), ("d", "fail here"), ("e", None), (None, "p2")]
    prompts = spark.createDataFrame(rows, "source string, prompt string").repartition(3)
    r = stored_replies(prompts, _counting(calls), replies=table)
    want = {("a", "P1", None), ("b", "P1", None), ("c", "P2", None), (None, "P2", None), ("e", None, None), ("d", None, "TimeoutError: slow")}
    for _ in range(2):  # two actions, one call per distinct prompt
        assert {tuple(x) for x in r.collect()} == want and r.count() == 6
    assert len(list(calls.iterdir())) == 3
    assert {p.read_text() for p in calls.iterdir()} == {P.SYSTEM_PROMPT}
    # A later run asks what is new and what failed before; another model is asked everything.
    more = spark.createDataFrame([("a", "p1"), ("d", "fail here"), ("x", "p9")], "source string, prompt string")
    again = stored_replies(more, _counting(calls), replies=table)
    assert {tuple(x) for x in again.collect()} == {("a", "P1", None), ("d", None, "TimeoutError: slow"), ("x", "P9", None)}
    assert len(list(calls.iterdir())) == 5
    stored_replies(more, _counting(calls), replies=table, model="other").collect()
    assert len(list(calls.iterdir())) == 8
    # Without a table the replies serve the one result.
    alone = stored_replies(more.where("source = 'a'"), _counting(calls))
    alone.collect(), alone.count()
    assert len(list(calls.iterdir())) == 9
    assert stored_replies(more.limit(0), _counting(calls)).collect() == []


def test_result_of_the_analysis_calls_the_model_once(spark, lines_df, tmp_path):
    r = analyze_with_model(_entries(lines_df), _counting(tmp_path))
    r.count(), r.collect(), result_json(r).collect()
    assert len(list(tmp_path.iterdir())) == 1


def test_shapes_against_the_plain_check(spark):
    """Valid reports with fields dropped or replaced at random: same verdict, reason and values as the plain check."""
    import random

    from report_shape import ShapeError, validate_report

    rnd = random.Random(5)
    values = [None, "x", "7", " 8 ", "+3.00", "5.5", "", 0, 3, -2, 4.0, 4.5, 1e3, True, False, [], ["a"], ["a", 1], [None], {}, {"message": "m"},
              [{"message": "m"}], [{"message": 1}], [{"error_type": "e", "occurrence_count": "2"}], [[]], {"assumptions": ["x"]},
              {"assumptions": None}, [{"warning_type": "w", "occurrence_count": 1, "first_occurrence": None}]]
    full = dict(VALID, warning_analysis=[{"warning_type": "w", "occurrence_count": "1", "last_occurrence": "t"}, {"warning_type": "v",
                "occurrence_count": 2}], pattern_detection=["p"], anomalies=[], likely_root_cause={"observed_facts": ["f"]},
                recommendations=["r"], interesting_log_snippets=["s", "t"])
    paths = [(k,) for k in full] + [("log_overview", k) for k in ("time_range", "total_lines_processed", "log_levels_observed", "thread_names")]
    paths += [("timeline", 0, k) for k in ("timestamp", "message", "source")] + [("error_analysis", 0), ("error_analysis", 0, "occurrence_count"),
              ("warning_analysis", 1), ("warning_analysis", 1, "short_explanation"), ("likely_root_cause", "possible_causes")]
    replies = {}
    for i in range(400):
        report = json.loads(json.dumps(full))
        for path in rnd.sample(paths, rnd.choice([1, 1, 1, 2])):
            at = report
            try:
                for k in path[:-1]:
                    at = at[k]
                if rnd.random() < 0.25 and isinstance(at, dict):
                    at.pop(path[-1], None)
                else:
                    at[path[-1]] = rnd.choice(values)
            except (TypeError, KeyError, IndexError):
                continue
        replies[f"r{i}"] = report
    df = spark.createDataFrame([(k, json.dumps(v), None) for k, v in replies.items()], "source string, response string, error string")
    accepted = 0
    for r in check_responses(df).collect():
        try:
            want, reason = validate_report(replies[r.source]), None
            accepted += 1
        except ShapeError as exc:
            want, reason = None, f"Report validation failed: {exc}"
        assert (r.llm_error, r.report and r.report.asDict(recursive=True)) == (reason, want), replies[r.source]
    assert 50 < accepted < 350


def test_counts_beyond_64_bits_are_refused(spark):
    over = json.dumps(dict(VALID, log_overview={"total_lines_processed": 2**63}))
    df = spark.createDataFrame([("a", over, None)], "source string, response string, error string")
    assert check_responses(df).first().llm_error == "Report validation failed: log_overview.total_lines_processed: input should be a valid integer"
