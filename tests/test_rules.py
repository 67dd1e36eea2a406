"""Rule tables: the one-pass matcher against ``in``, many rules, odd tables, and rules through the report."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logfold.operators.aggregates import source_summary
from logfold.operators.evidence import evidence_lines
from logfold.operators.parse import parse_lines
from logfold.operators.report import report_table, signal_columns
from logfold.operators.rules import DEFAULT_RULES, KINDS, MAX_KEYWORDS, RULE_DDL, RuleSet, rule_table


def messages_table(spark, messages):
    rows = [(f"s{i}", i, m, "ERROR") for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "source string, line_number long, message string, level string").select(
        "*", F.lit(None).cast("timestamp").alias("timestamp"), F.col("message").alias("raw"))


def test_masks_agree_with_substring_tests(spark):
    rnd = random.Random(3)
    alphabet = ["a", "b", "ab", "c", "(", "[", ".", "\\", "é", "😀", " ", "-", "^", "$", "{"]
    rules = [(KINDS[i % 4], i, f"r{i}", ["".join(rnd.choices(alphabet, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 4))])
             for i in range(150)]  # three longs of bits
    messages = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 12))) for _ in range(150)] + ["", None]
    rs = RuleSet.of(rule_table(spark, rules))
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    masks = rs.masks(F.col("m"), KINDS[:4])
    assert len(masks) == 3
    found = df.select("m", F.array(*masks).alias("b")).collect()
    for r in found:
        held = {s for i, (_, _, s, _) in enumerate(rs.rules) if r.b[i // 62] >> i % 62 & 1}
        assert held == {s for _, _, s, words in rules if r.m is not None and any(w in r.m for w in words)}, r.m


def test_default_rules_are_the_fixed_ones(spark):
    again = RuleSet.of(rule_table(spark))
    assert [(k, p, s, set(w)) for k, p, s, w in again.rules] == [(k, p, s, set(w)) for k, p, s, w in RuleSet.of(None).rules]
    assert len(again.rules) == len(DEFAULT_RULES)


def test_order_capitals_and_odd_rows(spark):
    rows = [("pattern", 2, "third", "x"), ("pattern", None, "first", "X"), ("pattern", 1, "second", "x"), ("pattern", 1, "second", "x"),
            ("pattern", 0, "empty never holds", ""), ("pattern", 0, "null never holds", None), ("anomaly", 5, None, "x")]
    rules = spark.createDataFrame(rows, RULE_DDL)
    got = signal_columns(source_summary(messages_table(spark, ["aXb", "y"]), rules), rules).orderBy("source").collect()
    assert got[0].detector_patterns == ["first", "second", "third"] and got[0].detector_anomalies == [""]
    assert got[1].detector_patterns == [] and got[1].detector_anomalies == []


def test_empty_rule_table_and_refusals(spark):
    none = spark.createDataFrame([], RULE_DDL)
    entries = messages_table(spark, ["start timeout"])
    row = signal_columns(source_summary(entries, none), none).first()
    assert row.detector_patterns == [] and row.pattern_detection == ["1 error events detected."]
    assert evidence_lines(entries, rules=none).where("section = 'lifecycle_lines'").count() == 0
    with pytest.raises(ValueError, match="unknown kinds"):
        RuleSet.of(spark.createDataFrame([("other", 0, "s", "k")], RULE_DDL))
    many = spark.range(MAX_KEYWORDS + 1).select(F.lit("pattern").alias("kind"), F.lit(0).alias("position"), F.lit("s").alias("sentence"),
                                                F.concat(F.lit("k"), "id").alias("keyword"))
    with pytest.raises(ValueError, match="more than"):
        RuleSet.of(many)


def test_rules_reach_every_part_of_the_report(spark, lines_df):
    lines = ["2024-01-01 10:00:00 ERROR disk quota exceeded", "2024-01-01 10:00:01 INFO disk swapped", "2024-01-01 10:00:02 INFO ready"]
    from logfold.operators.context import sequence_entries

    parsed = parse_lines(lines_df(lines).withColumn("block", F.lit(0)))
    entries = sequence_entries(parsed, ["line_number"]) if "line_number" not in parsed.columns else sequence_entries(
        parsed.withColumnRenamed("line_number", "k"), ["k"])
    rules = rule_table(spark, [("pattern", 0, "Disks and memory.", ("disk",)), ("anomaly", 0, "A quota ran out.", ("quota", "quota exceeded")),
                               ("lifecycle", 0, "", ("swapped",))])
    r = report_table(entries, rules=rules).first()
    assert r.pattern_detection == ["1 error events detected.", "Disks and memory."] and r.anomalies == ["A quota ran out."]
    assert r.likely_root_cause.observed_facts[1:] == ["Disks and memory.", "A quota ran out."]
    assert "Memory pressure affecting service stability." in r.likely_root_cause.possible_causes
    life = evidence_lines(entries, rules=rules).where("section = 'lifecycle_lines'").collect()
    assert [x.line_number for x in life] == [2]
