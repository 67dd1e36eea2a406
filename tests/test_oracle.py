"""Driver queries against their DuckDB oracles on the smallest scale factor."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

import __spark_entry__ as E  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not Path(SF).exists():
        pytest.skip("test data not available")
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    msg = check.compare(spark, duck, name, SF)
    assert ": OK" in msg, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["source", "section", "rank", "text"]
    assert df.count() > 0
