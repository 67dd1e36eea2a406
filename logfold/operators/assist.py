"""Model-assisted analysis as table jobs: evidence -> prompt -> completion -> checked report.

* :func:`evidence_bundle` - one bounded evidence struct per source (counts,
  statistics maps, at most 150/150/150/500 lines).
* :func:`analysis_prompt` / :func:`refinement_prompt` - prompt columns.
* :func:`complete` - ``mapInPandas`` that calls a caller-supplied client once
  per row (one client per partition and worker thread, optional concurrent
  calls per task); failures are captured per row.
* :func:`stored_replies` - asks each distinct prompt once: replies are written
  to a table keyed by the prompt's hash, and prompts that it answers already
  are not asked again.
* :func:`check_responses` - extracts the JSON object (a fenced block is
  preferred) and validates it against the report shape, in column expressions
  over VARIANT values.
* :func:`choose_reports` - per source, the model's report when it is valid,
  otherwise the heuristic report with the reason in ``llm_error``.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions import patterns as P
from logfold.functions.extract import ustrip
from logfold.functions.json_text import indented_json
from logfold.operators.aggregates import level_counts, source_summary, top_values
from logfold.operators.evidence import evidence_lines
from logfold.operators.joins import join_keys
from logfold.operators.rules import RuleSet
from logfold.staging import maybe_stage, stage

REPORT_FIELDS = (
    "executive_summary", "log_overview", "timeline", "error_analysis", "warning_analysis",
    "pattern_detection", "anomalies", "likely_root_cause", "recommendations", "interesting_log_snippets",
)


# --- evidence -----------------------------------------------------------------

def _map_of(dimension: str) -> Column:
    """Aggregate: the values of one dimension and their counts as a map in rank order (at most ten, or the levels)."""
    rows = F.collect_list(F.when(F.col("dimension") == dimension, F.struct("rank", "value", "n")))
    return F.map_from_entries(F.transform(F.array_sort(rows), lambda x: F.struct(x["value"], x["n"]))).alias(dimension)


def evidence_bundle(entries: DataFrame, stage_entries: bool = True, level_lines: int = P.EVIDENCE_LEVEL_LINES,
                    sample_lines: int = P.EVIDENCE_SAMPLE_LINES, rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """``(source, evidence)``; every nested list is bounded by the evidence caps."""
    entries = maybe_stage(entries, stage_entries, "entries")
    summ = source_summary(entries).select("source", "total_lines", "time_range")
    lv = level_counts(entries).select(
        "source", F.lit("levels").alias("dimension"), F.col("level").alias("value"), "n",
        F.row_number().over(Window.partitionBy("source").orderBy("first_line")).cast("bigint").alias("rank"))
    counts = lv.unionByName(top_values(entries).select("source", "dimension", "value", "n", "rank"))
    maps = counts.groupBy("source").agg(*[_map_of(d) for d in ("levels", "components", "request_ids", "thread_names")])
    ev = evidence_lines(entries, level_lines, sample_lines, rules)
    lists = ev.groupBy("source").pivot(
        "section", ["sample_lines", "error_lines", "warning_lines", "lifecycle_lines"]
    ).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    out = summ
    for part in (maps, lists):
        out = join_keys(out, part, ["source"])
    empty_map = F.create_map().cast("map<string,bigint>")
    empty = F.array().cast("array<string>")

    def lines(c: str):
        return F.coalesce(F.transform(c, lambda x: x["line"]), empty)

    stats = F.struct(
        F.col("total_lines").alias("total_lines"),
        F.coalesce("levels", empty_map).alias("levels"),
        F.coalesce("components", empty_map).alias("components"),
        F.coalesce("request_ids", empty_map).alias("request_ids"),
        F.coalesce("thread_names", empty_map).alias("thread_names"),
    )
    return out.select("source", F.struct(
        F.col("total_lines").alias("total_lines"),
        F.col("time_range").alias("time_range"),
        stats.alias("statistics"),
        lines("sample_lines").alias("sample_lines"),
        lines("error_lines").alias("error_lines"),
        lines("warning_lines").alias("warning_lines"),
        lines("lifecycle_lines").alias("lifecycle_lines"),
    ).alias("evidence"))


# --- prompts -------------------------------------------------------------------

def analysis_prompt(bundles: DataFrame) -> DataFrame:
    """``(source, prompt)`` from :func:`evidence_bundle` output."""
    head = (P.ANALYSIS_PROMPT_HEAD + P.ANALYSIS_RULES + "\n\nJSON schema:\n"
            + json.dumps(P.REPORT_SCHEMA_TEXT, indent=2) + "\n\nEvidence bundle:\n")
    body = indented_json(F.col("evidence"), bundles.schema["evidence"].dataType)
    return bundles.select("source", F.concat(F.lit(head), body).alias("prompt"))


def refinement_prompt(reports: DataFrame) -> DataFrame:
    """``(source, prompt)`` asking to refine an existing report (report columns as in REPORT_FIELDS)."""
    whole = reports.select("source", F.struct(*[F.col(c) for c in REPORT_FIELDS]).alias("report"))
    body = indented_json(F.col("report"), whole.schema["report"].dataType)
    return whole.select("source", F.concat(F.lit(P.REFINEMENT_PROMPT_HEAD + "Report:\n"), body).alias("prompt"))


# --- completion ----------------------------------------------------------------

def complete(prompts: DataFrame, client_factory: Callable[[], Any], concurrency: int = 1,
             system_prompt: str = P.SYSTEM_PROMPT, key: str = "source") -> DataFrame:
    """``(key, response, error)``: one ``client.generate(prompt)`` call per row, whenever the result is evaluated.

    The client is given ``system_prompt`` as its attribute of that name, unless it has one already.

    ``client_factory`` is called on the executor, once per partition and
    worker thread, so a client holding a connection is created near the data;
    it must be picklable (a top-level function or class).  ``concurrency``
    calls run at once per task (the calls wait on the model, not the CPU);
    results keep the row order.  A prompt can hold up to ~950 evidence lines,
    so a session running this step with many sources per partition should
    keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` small (for example
    64): batches then stay a few MB, and the model calls set the pace.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import threading
        from concurrent.futures import ThreadPoolExecutor

        local = threading.local()

        def call(prompt: str) -> tuple[str | None, str | None]:
            try:
                if getattr(local, "client", None) is None:
                    client = client_factory()
                    if not getattr(client, "system_prompt", None):
                        with contextlib.suppress(AttributeError):  # a client that takes no attributes
                            client.system_prompt = system_prompt
                    local.client = client
                return local.client.generate(prompt), None
            except Exception as exc:  # captured per row, never fails the task
                return None, f"{type(exc).__name__}: {exc}"

        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for pdf in batches:
                results = list(pool.map(call, pdf["prompt"]))
                yield pd.DataFrame({
                    key: pdf[key],
                    "response": [r for r, _ in results],
                    "error": [e for _, e in results],
                })

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} string, response string, error string")


def stored_replies(prompts: DataFrame, client_factory: Callable[[], Any], concurrency: int = 1, replies: str | None = None,
                   model: str = "", system_prompt: str = P.SYSTEM_PROMPT) -> DataFrame:
    """``(source, response, error)`` of stored replies: each distinct prompt is asked once, when this is called.

    ``replies`` is the path of a reply table (Parquet) that later calls read
    again and add to; without it the replies are kept in the staging folder, so
    only this call's results use them.  A prompt is known by the SHA-256 of
    ``model``, system prompt and prompt (``model`` is any text that tells
    models apart).  Failed calls are kept for the result but are asked again by
    a later call.  Of several replies to one prompt, as two runs at once may
    leave, the smallest text is used, so all sources with that prompt agree.
    A null prompt has neither reply nor error.
    """
    whole = F.concat_ws("\x00", F.lit(model), F.lit(system_prompt), F.col("prompt"))
    keyed = stage(prompts.select("source", "prompt", F.when(F.col("prompt").isNotNull(), F.sha2(whole.cast("binary"), 256)).alias("key")),
                  "prompts")
    ask = keyed.where("key is not null").dropDuplicates(["key"]).select("key", "prompt")
    spark, ddl = prompts.sparkSession, "key string, response string, error string"
    known = spark.createDataFrame([], ddl)
    if replies is not None:
        with contextlib.suppress(AnalysisException):  # the first call: there is no table yet
            known = spark.read.schema(ddl).parquet(replies)
            known = stage(known.where("response is not null").groupBy("key").agg(F.min("response").alias("response")).withColumn(
                "error", F.lit(None).cast("string")), "known-replies")
        ask = ask.join(known, "key", "left_anti")
    # Written once: further evaluations of the result read the table and call no client.
    new = stage(complete(ask, client_factory, concurrency, system_prompt, key="key"), "replies")
    if replies is not None:
        new.write.mode("append").parquet(replies)
    answers = known.unionByName(new)
    return keyed.join(answers, "key", "left").select("source", "response", "error")


# --- response checking ----------------------------------------------------------

# The fence of a JSON block and the reasons users see.
FENCED_JSON = r"```(?:json)?\s*([\s\S]*?)\s*```"
NOT_JSON = "LLM returned invalid JSON: "
NOT_AN_OBJECT = "LLM response must be a JSON object."

# One field's checked value: the column to put into the report, and the problem (null if there is none).
Checked = tuple[Column, Column]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _problem(bad: Column, path: Column, what: str) -> Column:
    return F.when(bad, F.concat(path, F.lit(f": input should be a valid {what}")))


def _text(v: Column, path: Column) -> Checked:
    return F.try_variant_get(v, "$", "string"), _problem(_kind(v) != "STRING", path, "string")


def _maybe_text(v: Column, path: Column) -> Checked:
    return F.try_variant_get(v, "$", "string"), _problem(~_kind(v).isin("STRING", "VOID"), path, "string")


#: A whole number as text, its fraction zeros only.
_WHOLE = r"\A[+-]?[0-9]+(\.0+)?\z"


def _whole(v: Column, path: Column) -> Checked:
    """Whole numbers, also as text, as a boolean or with a zero fraction; beyond 64 bits they are no valid count."""
    kind, words = _kind(v), ustrip(F.try_variant_get(v, "$", "string"))
    number, real = F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double")
    spelt = F.when(words.rlike(_WHOLE), F.split(words, r"\.", 2)[0].try_cast("bigint"))
    value = (F.when(kind.isin("BIGINT", "BOOLEAN"), number)
             .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.when(real == F.floor(real), number))
             .when(kind == "STRING", spelt))
    return value, _problem(value.isNull(), path, "integer")


def _texts(v: Column, path: Column) -> Checked:
    items = F.try_variant_get(v, "$", "array<variant>")
    each = F.transform(items, lambda x, i: _text(x, F.concat(path, F.lit("."), i.cast("string")))[1])
    first = F.get(F.filter(each, lambda p: p.isNotNull()), F.lit(0))
    return (F.transform(items, lambda x: _text(x, path)[0]),
            F.coalesce(_problem(items.isNull(), path, "list"), first))


def _object(fields: dict, v: Column, path: Column) -> Checked:
    """An object with ``fields``: name to (check, default or None if the field must be there)."""
    dot = F.concat(path, F.lit("."))
    return _fields(fields, v, dot, _problem(~_kind(v).startswith("OBJECT"), path, "dictionary"))


def _fields(fields: dict, v: Column, prefix: Column, problem: Column) -> Checked:
    values, problems = [], [problem]
    for name, (check, default) in fields.items():
        at, found = F.concat(prefix, F.lit(name)), _get(v, name)
        value, wrong = check(found, at)
        if default is None:
            problems.append(F.when(found.isNull(), F.concat(at, F.lit(": field required"))).otherwise(wrong))
        else:
            problems.append(F.when(found.isNotNull(), wrong))
            value = F.when(found.isNull(), default()).otherwise(value)
        values.append(value.alias(name))
    return F.struct(*values), F.coalesce(*problems)


def _objects(fields: dict) -> Callable[[Column, Column], Checked]:
    def check(v: Column, path: Column) -> Checked:
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _object(fields, x, F.concat(path, F.lit("."), i.cast("string")))[1])
        first = F.get(F.filter(each, lambda p: p.isNotNull()), F.lit(0))
        return (F.transform(items, lambda x: _object(fields, x, path)[0]),
                F.coalesce(_problem(items.isNull(), path, "list"), first))
    return check


def _group_fields(kind: str) -> dict:
    return {kind: (_text, None), "occurrence_count": (_whole, None), "first_occurrence": (_maybe_text, _null),
            "last_occurrence": (_maybe_text, _null), "short_explanation": (_text, lambda: F.lit(""))}


def _null() -> Column:
    return F.lit(None).cast("string")


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _report_fields() -> dict:
    """The report's fields in the order in which they are checked; unknown fields are ignored."""
    texts = (_texts, _no_texts)
    overview = {"time_range": (_maybe_text, _null), "total_lines_processed": (_whole, lambda: F.lit(0).cast("bigint")),
                "log_levels_observed": texts, "major_components": texts, "request_identifiers": texts, "thread_names": texts}
    event = {"timestamp": (_maybe_text, _null), "message": (_text, None), "source": (_maybe_text, _null)}
    cause = {"observed_facts": texts, "possible_causes": texts, "assumptions": texts}

    def none_of(fields: dict) -> Callable[[], Column]:
        return lambda: F.array().cast(f"array<{_ddl(fields)}>")

    def listed(fields: dict) -> tuple:
        return _objects(fields), none_of(fields)

    return {
        "executive_summary": (_text, None),
        "log_overview": (lambda v, p: _object(overview, v, p), None),
        "timeline": listed(event),
        "error_analysis": listed(_group_fields("error_type")),
        "warning_analysis": listed(_group_fields("warning_type")),
        "pattern_detection": texts,
        "anomalies": texts,
        "likely_root_cause": (lambda v, p: _object(cause, v, p), lambda: F.struct(*[_no_texts().alias(k) for k in cause])),
        "recommendations": texts,
        "interesting_log_snippets": texts,
    }


def _ddl(fields: dict) -> str:
    """Type of an item of flat ``fields``: whole numbers and texts."""
    return "struct<" + ",".join(f"{k}:{'bigint' if check is _whole else 'string'}" for k, (check, _) in fields.items()) + ">"


def check_responses(responses: DataFrame) -> DataFrame:
    """``(source, report, llm_error)``: ``report`` is the parsed struct (NULL when rejected).

    The JSON text is cut out, parsed to a VARIANT and validated field by field in
    column expressions.  A reply that is not JSON, not an object, nested beyond
    reason or of another shape gives a row with its reason: for the shape, the
    path of the first field that fails, in the report's order.
    """
    text = ustrip("response")
    fenced = F.when(text.rlike(FENCED_JSON), ustrip(F.regexp_extract(text, FENCED_JSON, 1)))
    replies = responses.select("source", F.nullif("error", F.lit("")).alias("failed"), F.coalesce(fenced, text).alias("body"))
    parsed = replies.select("source", "failed", "body", F.try_parse_json("body").alias("v"))
    reason = (
        F.when(F.col("failed").isNotNull(), F.col("failed"))
        .when(F.col("body").isNull(), F.lit("Model returned no content."))
        .when(F.col("v").isNull(), F.concat(F.lit(NOT_JSON), F.substring("body", 1, 80)))
        .when(~_kind(F.col("v")).startswith("OBJECT"), F.lit(NOT_AN_OBJECT))
    )
    judged = parsed.select("source", reason.alias("reason"), "v")
    report, problem = _fields(_report_fields(), F.col("v"), F.lit(""), F.lit(None).cast("string"))
    shaped = judged.select("source", "v", F.coalesce("reason", F.concat(F.lit("Report validation failed: "), problem)).alias("llm_error"))
    # Only replies without a reason are taken apart a second time, for their values.
    return shaped.select("source", F.when(F.col("llm_error").isNull(), report).alias("report"), "llm_error")


def choose_reports(static: DataFrame, checked: DataFrame | None) -> DataFrame:
    """Final result per source: the model report when valid, else the static one.

    ``static`` is :func:`logfold.plans.analysis.static_result` output; with
    ``checked = None`` (model step disabled) it is returned unchanged.
    """
    if checked is None:
        return static
    j = join_keys(static.drop("analysis_source", "llm_error"), checked.withColumnRenamed("llm_error", "_model_error"), ["source"])
    use = F.col("report").isNotNull()
    cols = [F.when(use, F.col("report")[c]).otherwise(F.col(c)).alias(c) for c in REPORT_FIELDS]
    return j.select(
        "source", *cols,
        F.when(use, F.lit("llm")).otherwise(F.lit("static_fallback")).alias("analysis_source"),
        F.when(use, F.lit(None)).otherwise(F.col("_model_error")).cast("string").alias("llm_error"),
    )
