"""Registration, driver queries against DuckDB, and the pipeline against brute force."""

from __future__ import annotations

import random
import re

import __spark_entry__ as E
import corpus_pipeline
import duckdb
import pytest
from test_packing import check
from test_quality import counts
from test_secrets import by_definition as secret_spans
from test_simhash import by_definition as fingerprint
from test_simhash import expected

from logfold.llm import language, secrets
from logfold.llm.oracles import ORACLES


def test_queries_are_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert "pipeline" in E.queries() and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[name](spark, sf)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = sorted(map(repr, rel.project(", ".join(cols)).limit(10**9).fetchall()))
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == want


def test_secret_query_digests(spark, sf):
    import hashlib

    rows = {r.doc_id: r for r in E.queries()["op10_secret_scan"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secret_spans(d.text))
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def odd_documents(spark, sf):
    """The documents with repeated, empty, null and very long rows, and columns of clashing names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rnd = random.Random(6)
    rows = [tuple(r) for r in docs.collect()]
    rows += rnd.sample(rows, 20)
    rows += [(9001, None, "en", "s", None), (9002, "", None, None, 0), (None, rows[3][1], "en", "s", 5), (9003, "12 34 " * 60, "en", "s", 360),
             (9005, "password=abc123def the and of that " + " ".join(f"on{i}er the thing" for i in range(40)), "en", "s", 9),
             (9004, "the and of thing that with for " + " ".join(f"than{chr(97 + i % 26)}er{chr(97 + i // 26 % 26)}" for i in range(30_000)),
              "en", "s", 1)]
    df = spark.createDataFrame([(*r, "c", 1, "d", 2) for r in rows], docs.schema.simpleString()[7:-1].replace(":", " ")
                               + ", fp string, row int, doc string, kept int")
    return df


def test_pipeline_stages_by_brute_force(spark, sf):
    docs = odd_documents(spark, sf)
    columns = docs.columns

    # 1: language
    model = language.fit(docs)
    out = corpus_pipeline.language_stage(spark, docs, sf)
    assert out.columns == columns
    scored = zip(docs.collect(), language.predict(docs, model).collect(), strict=True)
    want = [r for r, p in scored if p.lang_pred != "und" and p.score >= language.MIN_SCORE]
    rows = out.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and len(want) > 0.95 * docs.count() - 5

    # 2: quality; with so few labels no cutoff is certified and the base rules decide
    docs = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.quality_stage(spark, docs, sf)
    want = [r for r in rows if not ((c := counts(r.text))[0] < 50 or 100 * c[4] > 50 * c[0])]
    rows = out.collect()
    assert out.columns == columns and sorted(map(repr, rows)) == sorted(map(repr, want))

    # 3: near duplicates
    docs = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    low = expected([r.doc_id for r in rows], [fingerprint(r.text) for r in rows])
    kept = out.collect()
    assert out.columns == columns and sorted(r.doc_id for r in kept) == sorted(set(low)) and set(kept) <= set(rows)

    # 4: secrets
    docs = spark.createDataFrame(kept, docs.schema)
    out = corpus_pipeline.secrets_stage(spark, docs, sf)
    masked = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(masked) == {r.doc_id for r in kept}
    for r in kept:
        new = masked[r.doc_id].text
        assert not secret_spans(new) and masked[r.doc_id].n_chars == len(new)
        if "[secret]" not in new:
            assert new == r.text
    assert any("[secret]" in r.text for r in masked.values())

    # 5: packing
    docs = spark.createDataFrame(list(masked.values()), docs.schema)
    check(corpus_pipeline.packing_stage(spark, docs, sf).collect(), {d: r.text for d, r in masked.items()})


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for name, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, sf)
        assert docs.collect() == [], name
        docs = spark.createDataFrame([], docs.schema)
