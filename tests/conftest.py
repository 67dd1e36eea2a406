from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from logfold.session import local_session

    s = local_session(4, shuffle_partitions=4, app="logfold-tests")
    yield s
    s.stop()


@pytest.fixture()
def lines_df(spark):
    """Build a (source, line_number, raw_line) DataFrame from a list of lines."""

    def make(lines, source="s"):
        rows = [(source, i + 1, t) for i, t in enumerate(lines)]
        return spark.createDataFrame(rows, "source string, line_number long, raw_line string")

    return make
