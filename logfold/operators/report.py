"""Rule-derived incident report per source (heuristic path).

Builds every report section from the per-source aggregates with array and
string built-ins; the only joins are one-row-per-source tables on ``source``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions import patterns as P
from logfold.operators.aggregates import SIGNAL_KINDS, first_values, message_groups, source_summary
from logfold.operators.joins import join_keys
from logfold.operators.ranking import timeline
from logfold.operators.rules import RuleSet
from logfold.operators.snippets import snippets
from logfold.staging import maybe_stage

# A report nests all of its error / warning groups unless the caller passes a
# limit; ``error_groups`` / ``warning_groups`` give the same groups as rows,
# the form to use for a source with very many of them.
DEFAULT_NEST_LIMIT = None


def _compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _any_contains(arr: Column, word: str) -> Column:
    return F.exists(arr, lambda x: F.lower(x).contains(word))


def _str(c: Column) -> Column:
    return c.cast("string")


def _rows(df: DataFrame, part: str, **fields: Column | str) -> DataFrame:
    """Rows of one section in the common form ``(source, part, rank, a, b, c, d, n)``."""
    named = {k: F.col(v) if isinstance(v, str) else v for k, v in fields.items()}
    texts = [named.get(k, F.lit(None)).cast("string").alias(k) for k in "abcd"]
    return df.select("source", F.lit(part).alias("part"), F.col("rank"), *texts, named.get("n", F.lit(None)).cast("bigint").alias("n"))


def _of_dimension(d: str):
    return lambda x: x["dimension"] == d


def _list_of(part: str, **fields: str) -> Column:
    """Aggregate: the rows of ``part`` as an array of structs in rank order."""
    row = F.struct("rank", "a", "b", "c", "d", "n")
    rows = F.array_sort(F.collect_list(F.when(F.col("part") == part, row)))
    return F.transform(rows, lambda x: F.struct(*[x[v].alias(k) for k, v in fields.items()])).alias(part)


def filled(template: str, **values: Column) -> Column:
    """The text of a sentence template, with ``{name}`` replaced by a column; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def signal_columns(s: DataFrame, rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """Adds analyzer/detector pattern and anomaly lists to a :func:`source_summary` frame made with the same ``rules``."""
    rules = RuleSet.of(rules)
    masks = [F.get("rule_masks", F.lit(i)) for i in range(len(rules.masks(F.lit(""), SIGNAL_KINDS)))]
    analyzer_patterns = F.slice(F.concat(_compact(
        F.when(F.col("error_events") > 0, filled(P.SENT_ERROR_EVENTS, n=F.col("error_events"))),
        F.when(F.col("warning_events") > 0, filled(P.SENT_WARNING_EVENTS, n=F.col("warning_events"))),
    ), rules.sentences("analyzer_pattern", masks)), 1, P.ANALYZER_PATTERN_LIMIT)
    analyzer_anomalies = F.concat(_compact(
        F.when((F.col("error_events") > 0) & (F.col("warning_events") > 0), F.lit(P.SENT_WARN_WITH_ERRORS)),
    ), rules.sentences("analyzer_anomaly", masks))
    detector_patterns = rules.sentences("pattern", masks)
    detector_anomalies = rules.sentences("anomaly", masks)
    return s.select(
        "*",
        analyzer_patterns.alias("analyzer_patterns"),
        analyzer_anomalies.alias("analyzer_anomalies"),
        detector_patterns.alias("detector_patterns"),
        detector_anomalies.alias("detector_anomalies"),
    ).withColumns({
        "pattern_detection": F.array_distinct(F.concat("analyzer_patterns", "detector_patterns")),
        "anomalies": F.array_distinct(F.concat("analyzer_anomalies", "detector_anomalies")),
    })


def _empty_summary_defaults(summary: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Add listed sources without entries (empty files) to the summary.

    A full join: a source with entries is never dropped, even if the listing
    spells its path differently.
    """
    if sources is None:
        return summary
    j = sources.select("source").distinct().join(summary, "source", "full")
    fills = {c: F.coalesce(F.col(c), F.lit(0)) for c in
             ("total_lines", "error_events", "warning_events", "error_total", "warning_total")}
    fills["levels"] = F.coalesce(F.col("levels"), F.array().cast("array<string>"))
    fills["rule_masks"] = F.coalesce(F.col("rule_masks"), F.array().cast("array<bigint>"))
    return j.withColumns(fills)


def report_table(entries: DataFrame, sources: DataFrame | None = None,
                 nest_limit: int | None = DEFAULT_NEST_LIMIT, stage_entries: bool = True,
                 stage_groups: bool = True, rules: DataFrame | RuleSet | None = None) -> DataFrame:
    """One row per source with every report section as a column.

    ``rules`` replaces the built-in keyword rules (see :mod:`logfold.operators.rules`).

    ``sources`` (optional, column ``source``) lists sources that must appear
    even when they have no entries (empty files).  The entries feed about ten
    aggregates; with ``stage_entries`` they are written once to the checkpoint
    folder first (see :mod:`logfold.staging`); with ``stage_groups`` the
    ranked error groups, which feed four sections, are staged as well.
    """
    entries = maybe_stage(entries, stage_entries, "entries")
    rules = RuleSet.of(rules)
    summary = signal_columns(_empty_summary_defaults(source_summary(entries, rules), sources), rules)
    # The ranked groups feed four consumers (nested lists, facts, primary issue, snippets); staged with the
    # entries so the ranking runs once.
    groups = maybe_stage(message_groups(entries, stage=stage_groups), stage_groups, "message_groups")
    eg = groups.filter(F.col("kind") == "error").drop("kind")
    limit = F.lit(True) if nest_limit is None else F.col("rank") <= nest_limit
    listed = groups.filter(limit)
    fact = filled(P.FACT_GROUP, label=F.col("label"), n=F.col("occurrence_count"),
                  first=F.coalesce(F.col("first_occurrence"), F.lit("unknown")),
                  last=F.coalesce(F.col("last_occurrence"), F.lit("unknown")))
    group = {"a": "label", "b": "first_occurrence", "c": "last_occurrence", "d": "short_explanation", "n": "occurrence_count"}
    # How many groups exist in total (the nested lists may stop at nest_limit; the
    # full ranking is the error_groups / warning_groups table).
    totals = groups.groupBy("source").agg(F.count_if(F.col("kind") == "error").alias("e"), F.count_if(F.col("kind") == "warning").alias("w"))
    # All sections as rows of one form, nested by a single aggregation.
    parts = [
        _rows(listed.filter(F.col("kind") == "error"), "error_analysis", **group),
        _rows(listed.filter(F.col("kind") == "warning"), "warning_analysis", **group),
        _rows(eg.filter(F.col("rank") <= P.FACT_GROUPS), "_top", a=fact, b="label"),
        _rows(totals.withColumn("rank", F.lit(1)), "_totals", a=F.col("w"), n="e"),
        _rows(timeline(entries), "timeline", a="timestamp", b="message", c="level"),
        _rows(snippets(entries, eg), "_snip", a="raw"),
        _rows(first_values(entries).withColumn("n", F.lit(0)), "_values", a="value", b="dimension"),
    ]
    group = {"first_occurrence": "b", "last_occurrence": "c", "short_explanation": "d"}
    nested = reduce(DataFrame.unionByName, parts).groupBy("source").agg(
        _list_of("error_analysis", error_type="a", occurrence_count="n", **group),
        _list_of("warning_analysis", warning_type="a", occurrence_count="n", **group),
        _list_of("_top", fact="a", label="b"),
        _list_of("_totals", warnings="a", errors="n"),
        _list_of("timeline", timestamp="a", message="b", source="c"),
        _list_of("_snip", raw="a"),
        _list_of("_values", value="a", dimension="b"),
    )
    r = join_keys(summary, nested, ["source"])
    total = F.get("_totals", F.lit(0))
    r = r.withColumns({
        "_primary": F.get("_top", F.lit(0))["label"],
        "error_group_count": total["errors"], "warning_group_count": total["warnings"].cast("bigint"),
        **{d: F.transform(F.filter("_values", _of_dimension(d)), lambda x: x["value"]) for d in ("component", "request_id", "thread_name")},
    })
    empty_s = F.array().cast("array<string>")

    def arr(c: str) -> Column:
        return F.coalesce(F.col(c), empty_s)

    facts = F.concat(
        F.coalesce(F.transform("_top", lambda x: x["fact"]), empty_s),
        F.slice("detector_patterns", 1, P.FACT_LIST_LIMIT),
        F.slice("detector_anomalies", 1, P.FACT_LIST_LIMIT),
    )
    has_err = F.col("error_total") > 0
    has_warn = F.col("warning_total") > 0
    r = r.withColumn("observed_facts", facts)
    causes = _compact(*[F.when(_any_contains(F.col("observed_facts"), w), F.lit(s)) for w, s in P.CAUSE_RULES])
    causes = F.when((F.size(causes) == 0) & has_err, F.array(F.lit(P.CAUSE_DEFAULT))).otherwise(causes)
    assumptions = F.when(F.size("observed_facts") == 0, F.array(F.lit(P.ASSUMPTION_NO_FACTS))).otherwise(empty_s)
    recs = _compact(
        F.when(has_err, F.lit(P.REC_ERRORS)),
        F.when(has_warn, F.lit(P.REC_WARNINGS)),
        *[F.when(_any_contains(F.col("detector_patterns"), w), F.lit(s)) for w, s in P.REC_PATTERN_RULES],
    )
    recs = F.slice(F.when(F.size(recs) == 0, F.array(F.lit(P.REC_DEFAULT))).otherwise(recs), 1, P.RECOMMENDATION_LIMIT)

    health = F.when(has_err & has_warn, F.lit("degraded")).when(has_err, F.lit("failed")).otherwise(F.lit("healthy"))
    levels_txt = F.when(F.size("levels") > 0, F.array_join("levels", ", ")).otherwise(F.lit("unknown"))
    summary_txt = F.when(F.col("total_lines") == 0, F.lit(P.SUMMARY_EMPTY)).otherwise(F.concat_ws(
        " ",
        filled(P.SUMMARY_COUNT, n=F.col("total_lines"), levels=levels_txt),
        filled(P.SUMMARY_RANGE, range=F.col("time_range")),
        filled(P.SUMMARY_HEALTH, health=health, errors=F.col("error_total"), warnings=F.col("warning_total")),
        filled(P.SUMMARY_PRIMARY, label=F.substring("_primary", 1, P.PRIMARY_ISSUE_CHARS)),
    ))

    overview = F.struct(
        F.col("time_range").alias("time_range"),
        F.col("total_lines").cast("bigint").alias("total_lines_processed"),
        F.col("levels").alias("log_levels_observed"),
        arr("component").alias("major_components"),
        arr("request_id").alias("request_identifiers"),
        arr("thread_name").alias("thread_names"),
    )
    empty_tl = F.array().cast("array<struct<timestamp:string,message:string,source:string>>")
    empty_eg = F.array().cast(
        "array<struct<error_type:string,occurrence_count:bigint,first_occurrence:string,"
        "last_occurrence:string,short_explanation:string>>")
    empty_wg = F.array().cast(
        "array<struct<warning_type:string,occurrence_count:bigint,first_occurrence:string,"
        "last_occurrence:string,short_explanation:string>>")
    return r.select(
        "source",
        summary_txt.alias("executive_summary"),
        overview.alias("log_overview"),
        F.coalesce(F.col("timeline"), empty_tl).alias("timeline"),
        F.coalesce(F.col("error_analysis"), empty_eg).alias("error_analysis"),
        F.coalesce(F.col("warning_analysis"), empty_wg).alias("warning_analysis"),
        F.col("pattern_detection"),
        F.col("anomalies"),
        F.struct(
            F.col("observed_facts").alias("observed_facts"),
            causes.alias("possible_causes"),
            assumptions.alias("assumptions"),
        ).alias("likely_root_cause"),
        recs.alias("recommendations"),
        F.coalesce(F.transform("_snip", lambda x: x["raw"]), empty_s).alias("interesting_log_snippets"),
        F.col("error_total").alias("error_occurrences"),
        F.col("warning_total").alias("warning_occurrences"),
        F.coalesce(F.col("error_group_count"), F.lit(0)).alias("error_group_count"),
        F.coalesce(F.col("warning_group_count"), F.lit(0)).alias("warning_group_count"),
    )


REPORT_SECTIONS = (
    "executive_summary", "pattern_detection", "anomalies", "observed_facts",
    "possible_causes", "assumptions", "recommendations", "interesting_log_snippets",
)


def report_sections(report: DataFrame) -> DataFrame:
    """Flat ``(source, section, rank, text)`` rows of the text sections of a report table."""
    cols = {
        "executive_summary": F.array("executive_summary"),
        "pattern_detection": F.col("pattern_detection"),
        "anomalies": F.col("anomalies"),
        "observed_facts": F.col("likely_root_cause.observed_facts"),
        "possible_causes": F.col("likely_root_cause.possible_causes"),
        "assumptions": F.col("likely_root_cause.assumptions"),
        "recommendations": F.col("recommendations"),
        "interesting_log_snippets": F.col("interesting_log_snippets"),
    }
    parts = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("items")) for k, v in cols.items()])
    return (
        report.select("source", F.explode(parts).alias("p"))
        .select("source", "p.section", F.posexplode("p.items").alias("pos", "text"))
        .select("source", "section", (F.col("pos") + 1).cast("bigint").alias("rank"), "text")
    )
