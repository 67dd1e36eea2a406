"""End-to-end plans: files or tables -> entries -> report / evidence / result.

These compose the operators into the plans a user runs.  The DataFrames they
return are lazy, but tables that feed several consumers (parsed lines, entries,
groups) are written while the plan is built; :func:`logfold.staging.staging_run`
removes them when their results are stored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions.patterns import ALLOWED_EXTENSIONS
from logfold.operators.report import DEFAULT_NEST_LIMIT, report_table
from logfold.operators.rules import RuleSet
from logfold.sources.admission import admission_audit, split_inputs
from logfold.sources.text_files import read_log_entries

ENTRY_COLUMNS = (
    "source", "line_number", "raw", "entry_type", "timestamp", "level", "logger", "message",
    "thread_name", "component", "request_id", "trace_id", "client_ip", "http_status",
)

REPORT_FIELDS = (
    "executive_summary", "log_overview", "timeline", "error_analysis", "warning_analysis",
    "pattern_detection", "anomalies", "likely_root_cause", "recommendations", "interesting_log_snippets",
)


def entries_view(entries: DataFrame) -> DataFrame:
    """The public entries schema (drops block / ordering helpers)."""
    return entries.select(*ENTRY_COLUMNS)


def static_result(entries: DataFrame, sources: DataFrame | None = None,
                  nest_limit: int | None = DEFAULT_NEST_LIMIT, stage_entries: bool = True,
                  rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """Heuristic report per source with ``analysis_source = 'static_fallback'``."""
    rep = report_table(entries, sources, nest_limit, stage_entries, rules=rules)
    return rep.select(
        "source", *REPORT_FIELDS,
        F.lit("static_fallback").alias("analysis_source"),
        F.lit(None).cast("string").alias("llm_error"),
    )


def analyze_files(spark: SparkSession, paths: str | list[str],
                  extensions: Iterable[str] | str = ALLOWED_EXTENSIONS,
                  max_file_size_mb: float | None = None,
                  nest_limit: int | None = DEFAULT_NEST_LIMIT, rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """Static report for every admitted log file under ``paths`` (files, directories or globs; empty files included)."""
    existing, _ = split_inputs(spark, paths)
    if not existing:
        raise FileNotFoundError(f"none of the input paths exists: {paths}")
    audit = admission_audit(spark, existing, extensions, max_file_size_mb)
    admitted = audit.filter(F.col("status") == "admitted").select(F.col("path").alias("source"))
    entries = read_log_entries(spark, existing, extensions, max_file_size_mb)
    return static_result(entries, admitted, nest_limit, rules=rules)


def result_json(result: DataFrame, include_source: bool = False) -> DataFrame:
    """``(source, json)``: the report object with ``analysis_source`` and, only when
    set, ``llm_error``; null fields inside the report are kept."""
    opts = {"ignoreNullFields": "false"}
    base = ([F.col("source")] if include_source else []) + [F.col(c) for c in REPORT_FIELDS] + [F.col("analysis_source")]
    without = F.to_json(F.struct(*base), opts)
    with_err = F.to_json(F.struct(*base, F.col("llm_error")), opts)
    has_err = F.col("llm_error").isNotNull() & (F.col("llm_error") != "")
    return result.select("source", F.when(has_err, with_err).otherwise(without).alias("json"))


def write_results(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines sink: one report object per line and source (``source`` kept as a field)."""
    result_json(result, include_source=True).select("json").write.mode(mode).text(path)


def analyze_with_model(entries: DataFrame, client_factory, sources: DataFrame | None = None,
                       nest_limit: int | None = DEFAULT_NEST_LIMIT, concurrency: int = 1,
                       rules: DataFrame | RuleSet | None = None, replies: str | None = None, model: str = "") -> DataFrame:
    """Model-first analysis: evidence -> prompt -> completion -> check, with the
    heuristic report as the per-source fallback (``llm_error`` says why).

    The model is called while this function runs, once per distinct prompt;
    evaluating the result calls it no more.  ``replies`` names a table that
    keeps the replies for later runs (see :func:`logfold.operators.assist.stored_replies`).
    """
    from logfold.operators.assist import (
        analysis_prompt, check_responses, choose_reports, evidence_bundle, stored_replies,
    )
    from logfold.staging import stage

    if client_factory is None:
        return static_result(entries, sources, nest_limit, rules=rules)
    entries = stage(entries, "entries")
    rules = RuleSet.of(rules)
    static = static_result(entries, sources, nest_limit, stage_entries=False, rules=rules)
    prompts = analysis_prompt(evidence_bundle(entries, stage_entries=False, rules=rules))
    checked = check_responses(stored_replies(prompts, client_factory, concurrency, replies, model))
    return choose_reports(static, checked)
