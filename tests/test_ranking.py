"""Skew-safe ranking equals the single-window ranking."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from logfold.operators.ranking import rank_by_count


def test_rank_by_count_matches_window(spark):
    rnd = random.Random(7)
    rows = []
    for src, n in (("hot", 3000), ("cold", 40), (None, 30), ("mid", 400)):
        lines = rnd.sample(range(1, 100000), n)
        for i, line in enumerate(lines):
            rows.append((src, f"k{i}", rnd.choice([1, 1, 1, 2, 3, 5, 8]), line))
    df = spark.createDataFrame(rows, "source string, key string, occurrence_count long, first_line long")
    got = {(r.source, r.key): r.rank for r in rank_by_count(df).collect()}
    w = Window.partitionBy("source").orderBy(F.col("occurrence_count").desc(), "first_line")
    want = {(r.source, r.key): r.rank for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    assert got == want
