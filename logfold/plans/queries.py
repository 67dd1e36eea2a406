"""Flat driver queries, one per operator family, over the derived corpora.

Every query reads the whole ``events`` or ``documents`` table of a scale
factor directory and returns flat scalar columns (BIGINT / STRING) whose
names match the DuckDB oracle in :mod:`logfold.plans.oracle`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions.extract import iso_text
from logfold.operators import aggregates as A
from logfold.operators.evidence import evidence_lines
from logfold.operators.ranking import timeline
from logfold.operators.report import report_sections, report_table, signal_columns
from logfold.operators.rules import RuleSet, rule_table
from logfold.operators.snippets import snippets
from logfold.sources.corpus import branch_entries, doc_entries, ev_entries
from logfold.staging import stage

ENTRY_OUT = (
    "source", "line_number", "raw", "entry_type", "ts", "level", "logger", "message",
    "thread_name", "component", "request_id", "trace_id", "client_ip", "http_status",
)


def _flat_entries(e: DataFrame) -> DataFrame:
    # A nullable integer is exposed as text: engines differ in how they hand
    # a BIGINT column with NULLs to pandas (float vs nullable integer).
    return (e.withColumn("ts", iso_text(F.col("timestamp")))
            .withColumn("http_status", F.col("http_status").cast("string")).select(*ENTRY_OUT))


def q_parse_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_entries(ev_entries(spark, sf))


def q_parse_fields_doc(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_entries(doc_entries(spark, sf))


def q_parse_branches(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_entries(branch_entries(spark, sf))


def q_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """EV corpus written as text files, then read back through the file source.

    Exercises the text-file path end to end (scan, block offsets, carry
    across blocks); ``source`` is ``<service>#<chunk>`` taken from the path.
    """
    from logfold.sources.corpus import write_event_log_files
    from logfold.sources.text_files import read_log_entries

    path = write_event_log_files(spark, sf)
    e = read_log_entries(spark, path, extensions=[".txt"])
    src = F.concat(F.regexp_extract("source", r"source=([^/]+)/", 1), F.lit("#"),
                   F.regexp_extract("source", r"chunk=([0-9]+)/", 1))
    return _flat_entries(e.withColumn("source", src))


def q_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Admission audit over the EV corpus as text files next to a JSON copy of the events (not a log)."""
    from logfold.sources.admission import admission_audit
    from logfold.sources.corpus import table, write_event_log_files

    path = write_event_log_files(spark, sf)
    table(spark, sf, "events").write.json(f"{path}-json")
    audit = admission_audit(spark, [path, f"{path}-jso?"])  # the second as a glob
    folder = F.concat(F.regexp_extract("path", r"source=([^/]+)/", 1), F.lit("#"), F.regexp_extract("path", r"chunk=([0-9]+)/", 1))
    admitted = F.col("status") == "admitted"
    return audit.groupBy(F.when(admitted, folder).otherwise(F.lit("json")).alias("folder"), "status",
                         F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.sum(F.when(admitted, F.col("size")).otherwise(F.lit(0))).alias("bytes"))


def q_file_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Audit and reports of files with bytes that are no UTF-8, an empty one, one above the size limit, one of
    another type and a missing one; the limit is one byte below the largest log file."""
    from logfold.plans.analysis import analyze_files
    from logfold.sources.admission import admission_audit
    from logfold.sources.corpus import write_odd_log_files

    path = write_odd_log_files(spark, sf)
    inputs = [path, f"{path}/name=missing"]
    largest = admission_audit(spark, path).where("status = 'admitted'").agg(F.max("size")).first()[0] or 1
    limit = (largest - 1) / (1 << 20)  # exact: a power of two divides a whole number
    audit = admission_audit(spark, inputs, max_file_size_mb=limit)
    reports = analyze_files(spark, inputs, max_file_size_mb=limit)
    name = F.regexp_extract("path", "name=([^/]+)", 1)
    reason = F.coalesce(F.regexp_replace("reason", "limit of .*", "limit"), F.lit(""))
    judged = audit.groupBy("path", name.alias("name"), "status", reason.alias("reason")).agg(F.sum("size").alias("bytes"))
    joined = judged.join(reports.withColumnRenamed("source", "path"), "path", "left")
    kept = F.col("status") == "admitted"
    return joined.groupBy("name", "status", "reason").agg(
        F.sum(F.when(kept, F.col("bytes")).otherwise(F.lit(0))).alias("bytes"),
        F.max("executive_summary").alias("executive_summary"),
        F.max(F.array_join("interesting_log_snippets", "|")).alias("snippets"),
        F.max(F.array_join("recommendations", "|")).alias("recommendations"),
        F.max(F.col("log_overview.total_lines_processed").cast("string")).alias("total_lines"))


def q_line_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return doc_entries(spark, sf).select("source", "line_number", "raw")


def q_access_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = ev_entries(spark, sf).filter(F.col("entry_type") == "access_log")
    return e.select("source", "line_number", "client_ip", "http_status",
                    iso_text(F.col("timestamp")).alias("ts"), "message")


def q_structured_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = ev_entries(spark, sf).filter(F.col("entry_type") == "structured")
    return e.select("source", "line_number", "level", iso_text(F.col("timestamp")).alias("ts"),
                    "thread_name", "trace_id", "request_id", "logger", "message")


def q_context_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = ev_entries(spark, sf).filter(F.col("entry_type").isin("exception", "stack_trace"))
    return e.select("source", "line_number", "entry_type", "level", "request_id",
                    "thread_name", "logger", "trace_id")


def overview_of(e: DataFrame) -> DataFrame:
    s = A.source_summary(e)
    return s.select("source", "total_lines", "time_range",
                    F.array_join("levels", ", ").alias("levels"), "error_total", "warning_total")


def q_overview(spark: SparkSession, sf: str) -> DataFrame:
    return overview_of(ev_entries(spark, sf))


def q_overview_doc(spark: SparkSession, sf: str) -> DataFrame:
    return overview_of(doc_entries(spark, sf))


def q_first_values(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_values(ev_entries(spark, sf)).select("source", "dimension", "value", "rank")


def q_stats_levels(spark: SparkSession, sf: str) -> DataFrame:
    return A.level_counts(ev_entries(spark, sf)).select("source", "level", "n", "first_line")


def q_stats_top10(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_values(ev_entries(spark, sf)).select("source", "dimension", "value", "n", "first_line", "rank")


def _groups_out(g: DataFrame) -> DataFrame:
    return g.select("source", "rank", "label", "occurrence_count", "first_occurrence",
                    "last_occurrence", "first_line")


def q_error_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _groups_out(A.error_groups(ev_entries(spark, sf), stage=True))


def q_warning_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _groups_out(A.warning_groups(ev_entries(spark, sf), stage=True))


def q_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(ev_entries(spark, sf))


def q_timeline_doc(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(doc_entries(spark, sf))


def signals_of(e: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    rules = RuleSet.of(rules)
    s = signal_columns(A.source_summary(e, rules), rules)
    return s.select(
        "source", "error_events", "warning_events",
        F.array_join("pattern_detection", " | ").alias("pattern_detection"),
        F.array_join("anomalies", " | ").alias("anomalies"),
    )


def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals_of(ev_entries(spark, sf))


def q_signals_doc(spark: SparkSession, sf: str) -> DataFrame:
    return signals_of(doc_entries(spark, sf))


#: A second rule set (parameters of the query): keywords within keywords, over several kinds, with regex characters,
#: capitals, other letters, and two rules of one keyword.
CUSTOM_RULES = (
    ("analyzer_pattern", 0, "Slow answers.", ("slow response", "slow", "Slow Answer")),
    ("analyzer_anomaly", 0, "Refusals.", ("refused by", "refused", "declined")),
    ("pattern", 0, "A database is named.", ("Database", "data", "database connection timeouts")),
    ("pattern", 1, "Attempts.", ("attempt", "retry attempt")),
    ("pattern", 1, "Second rule of one place and keyword.", ("attempt",)),
    ("pattern", 2, "Server errors.", (" 500", "500 ", "502")),
    ("pattern", 3, "Dots and brackets.", ("fooexception: ", "a.b|c", "(", "[x]*")),
    ("pattern", 4, "Other letters.", ("ü", "größe")),
    ("anomaly", 0, "Usage is high.", ("usage high", "memory usage highest")),
    ("anomaly", 1, "Started or initiated.", ("application start", "initiated", "application started now")),
    ("anomaly", 2, "Nothing holds this.", ("no such words anywhere",)),
    ("lifecycle", 0, "", ("refused", "slow", "at com.", "retrying", "[")),
)


def q_signals_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The signals of every EV source under a rule table given by the caller."""
    return signals_of(ev_entries(spark, sf), rule_table(spark, CUSTOM_RULES))


def q_evidence_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence lines of every EV source under a rule table given by the caller."""
    return evidence_lines(stage(ev_entries(spark, sf), "entries"), rules=rule_table(spark, CUSTOM_RULES))


def q_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return snippets(stage(ev_entries(spark, sf), "entries"))


def q_evidence_lines(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_lines(stage(ev_entries(spark, sf), "entries"))


def q_report_sections(spark: SparkSession, sf: str) -> DataFrame:
    return report_sections(report_table(ev_entries(spark, sf)))


def q_report_sections_doc(spark: SparkSession, sf: str) -> DataFrame:
    return report_sections(report_table(doc_entries(spark, sf)))


# --- model-assisted path ----------------------------------------------------------

def label_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Completion results synthesised from ``labels`` (one per labelled document).

    Eighteen shapes by ``doc_id % 18``: fenced and bare valid reports, text that
    is no JSON, an array, null, deep nesting, missing, null and wrongly typed
    fields at every level, and counts in every spelling; toxic documents with
    ``doc_id % 5 = 0`` simulate a client error.
    """
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    d = F.col("doc_id").cast("string")
    n = (F.col("doc_id") % 100).cast("string")
    fixed = {
        "SUMMARY": F.concat(F.lit('"executive_summary": "Doc '), d, F.lit(" quality "), F.col("quality").cast("string"), F.lit('"')),
        "OVERVIEW": F.concat(F.lit('"log_overview": {"total_lines_processed": '), n, F.lit(', "log_levels_observed": ["INFO"]}')),
        "GROUP": F.concat(F.lit('"error_analysis": [{"error_type": "E'), (F.col("doc_id") % 7).cast("string"),
                          F.lit('", "occurrence_count": ')),
        "DOC": d, "N": n,
    }
    resp = F.lit(None).cast("string")
    for i, shape in enumerate(REPLY_SHAPES):
        parts = [fixed.get(x, F.lit(x)) for x in re.split(r"\b(SUMMARY|OVERVIEW|GROUP|DOC|N)\b", shape) if x]
        resp = F.when(F.col("doc_id") % len(REPLY_SHAPES) == i, F.concat(*parts)).otherwise(resp)
    failed = (F.col("toxic") == 1) & (F.col("doc_id") % 5 == 0)
    return lab.select(
        d.alias("source"),
        F.when(~failed, resp).alias("response"),
        F.when(failed, F.lit("RuntimeError: upstream unavailable")).alias("error"),
    )


#: Replies by shape; words in capitals stand for texts of the document.
REPLY_SHAPES = (
    "Here is the report:\n```json\n{SUMMARY, OVERVIEW, GROUP N}]}\n```",
    '{SUMMARY, OVERVIEW, GROUP "N"}], "extra": 1}',
    "not json DOC",
    "[1, 2]",
    "{SUMMARY}",
    '{SUMMARY, OVERVIEW, "timeline": null}',
    '{SUMMARY, OVERVIEW, "timeline": [{"timestamp": null, "message": "m"}, {"timestamp": "t"}]}',
    '{"executive_summary": 5, OVERVIEW}',
    '{SUMMARY, "log_overview": {"total_lines_processed": "N.0"}, GROUP N.0}]}',
    '{SUMMARY, "log_overview": {"total_lines_processed": "N.5"}}',
    '{SUMMARY, "log_overview": [], "anomalies": ["a"]}',
    '{SUMMARY, OVERVIEW, GROUP N.25}]}',
    '{SUMMARY, OVERVIEW, GROUP true}], "pattern_detection": ["a", 1]}',
    '{SUMMARY, OVERVIEW, GROUP true}], "likely_root_cause": {"assumptions": ["x"], "other": {}}}',
    '{SUMMARY, OVERVIEW, "likely_root_cause": {"observed_facts": "x"}}',
    '```\n  {SUMMARY, OVERVIEW, GROUP 1}, "E"]}  \n``` and more',
    "null",
    '{SUMMARY, OVERVIEW, "warning_analysis": [{"warning_type": "W", "occurrence_count": 1, "first_occurrence": 3}]}',
)


def q_model_choice(spark: SparkSession, sf: str) -> DataFrame:
    from logfold.operators.assist import check_responses

    c = check_responses(label_responses(spark, sf))
    # A text that is no JSON is quoted in the reason; the reason's fixed part is compared.
    reason = F.regexp_replace("llm_error", "(?s)(invalid JSON): .*", "$1")
    return c.select(
        "source",
        F.when(F.col("report").isNotNull(), F.lit("llm")).otherwise(F.lit("static_fallback")).alias("analysis_source"),
        reason.alias("reason"),
        F.col("report.executive_summary").alias("executive_summary"),
        F.col("report.log_overview.total_lines_processed").cast("string").alias("total_lines"),
        F.try_element_at(F.col("report.error_analysis"), F.lit(1))["occurrence_count"].cast("string").alias("first_count"),
        F.size("report.likely_root_cause.assumptions").cast("string").alias("n_assumptions"),
    )


class EvidenceReader:
    """Stand-in for a model: answers from the evidence in the prompt, in one of five ways by its line count."""

    def generate(self, prompt: str) -> str:
        evidence = json.loads(prompt.partition("Evidence bundle:\n")[2])
        n, levels = evidence["total_lines"], evidence["statistics"]["levels"]
        report = {
            "executive_summary": f"{self.system_prompt.split('.')[0]}: {n} lines, {len(evidence['error_lines'])} error lines",
            "log_overview": {"total_lines_processed": str(n), "time_range": evidence["time_range"]},
            "error_analysis": [{"error_type": k, "occurrence_count": v} for k, v in levels.items()],
        }
        if n % 5 == 2:
            raise RuntimeError(f"no capacity for {n} lines")
        if n % 5 == 3:
            return f"I cannot read {n} lines."
        if n % 5 == 4:
            del report["log_overview"]
        return f"Here it is:\n```json\n{json.dumps(report)}\n```" if n % 5 == 0 else json.dumps(report)


def q_model_report(spark: SparkSession, sf: str) -> DataFrame:
    """Model-first reports of the EV sources, completions stored, the heuristic report where the reply is unusable."""
    from logfold.plans.analysis import analyze_with_model

    r = analyze_with_model(ev_entries(spark, sf), EvidenceReader)
    first = F.try_element_at("error_analysis", F.lit(1))
    return r.select(
        "source", "analysis_source", "llm_error", "executive_summary",
        F.col("log_overview.total_lines_processed").alias("total_lines"), F.col("log_overview.time_range").alias("time_range"),
        first["error_type"].alias("first_group"), first["occurrence_count"].cast("string").alias("first_count"),
        F.size("error_analysis").cast("bigint").alias("n_groups"))


def q_report_json(spark: SparkSession, sf: str) -> DataFrame:
    """The nested report per EV source as its JSON document (the sink's rows)."""
    from logfold.plans.analysis import result_json, static_result

    return result_json(static_result(ev_entries(spark, sf)), include_source=True)


def q_evidence_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The whole evidence bundle per EV source as rows: totals, statistics maps and all lines, in their order."""
    from logfold.operators.assist import evidence_bundle

    b = evidence_bundle(ev_entries(spark, sf)).select("source", "evidence.*")
    maps = {d: F.transform(F.map_entries(f"statistics.{d}"), lambda e: F.struct(e["key"].alias("text"), e["value"].alias("n")))
            for d in ("levels", "components", "request_ids", "thread_names")}
    totals = {"total_lines": F.array(F.struct(F.lit(None).cast("string").alias("text"), F.col("total_lines").alias("n"))),
              "statistics_total": F.array(F.struct(F.lit(None).cast("string").alias("text"), F.col("statistics.total_lines").alias("n"))),
              "time_range": F.array(F.struct(F.col("time_range").alias("text"), F.lit(0).cast("bigint").alias("n")))}
    lines = {c: F.transform(c, lambda x: F.struct(x.alias("text"), F.lit(0).cast("bigint").alias("n")))
             for c in ("sample_lines", "error_lines", "warning_lines", "lifecycle_lines")}
    parts = F.array(*[F.struct(F.lit(k).alias("part"), v.alias("items")) for k, v in {**totals, **maps, **lines}.items()])
    rows = b.select("source", F.explode(parts).alias("p")).select("source", "p.part", F.posexplode("p.items").alias("pos", "item"))
    return rows.select("source", "part", (F.col("pos") + 1).cast("bigint").alias("rank"), "item.text", "item.n")


def q_prompt(spark: SparkSession, sf: str) -> DataFrame:
    from logfold.operators.assist import analysis_prompt, evidence_bundle

    return analysis_prompt(evidence_bundle(ev_entries(spark, sf)))


def q_refinement(spark: SparkSession, sf: str) -> DataFrame:
    from logfold.operators.assist import refinement_prompt
    from logfold.plans.analysis import static_result

    return refinement_prompt(static_result(ev_entries(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_fields": q_parse_fields,
    "parse_fields_doc": q_parse_fields_doc,
    "parse_branches": q_parse_branches,
    "line_numbering": q_line_numbering,
    "file_scan": q_file_scan,
    "access_lines": q_access_lines,
    "structured_lines": q_structured_lines,
    "context_fill": q_context_fill,
    "overview": q_overview,
    "overview_doc": q_overview_doc,
    "first_values": q_first_values,
    "stats_levels": q_stats_levels,
    "stats_top10": q_stats_top10,
    "error_groups": q_error_groups,
    "warning_groups": q_warning_groups,
    "timeline": q_timeline,
    "timeline_doc": q_timeline_doc,
    "signals": q_signals,
    "signals_doc": q_signals_doc,
    "signals_rules": q_signals_rules,
    "evidence_rules": q_evidence_rules,
    "snippets": q_snippets,
    "evidence_lines": q_evidence_lines,
    "report_sections": q_report_sections,
    "report_sections_doc": q_report_sections_doc,
    "model_choice": q_model_choice,
    "evidence_bundle": q_evidence_bundle,
    "prompt": q_prompt,
    "refinement": q_refinement,
    "model_report": q_model_report,
    "report_json": q_report_json,
    "admission": q_admission,
    "file_reports": q_file_reports,
}
