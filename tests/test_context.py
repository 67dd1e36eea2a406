"""Two-level carry-forward equals a plain sequential pass, for any block size."""

from __future__ import annotations

import random

import pytest

import logfold.sources.tables as T
from logfold.functions.patterns import KNOWN_LEVELS
from logfold.sources.tables import entries_from_lines

LINES = [
    "2024-01-01 10:00:00 ERROR boom request_id=r{n} thread=t{n}",
    "[INFO] [2024-01-01 10:00:00,1] [pool-1-thread-{n}] T:tr{n} - R:q{n} [Svc{n}]: ok",
    "[WARN] [2024-01-01 10:00:00,1] [dw-{n}] T:_default_ - R:_default_ [Job]: x",
    "plain text {n}",
    "com.example.Err{n}Exception: bad",
    "\tat a.b.C.d(C.java:{n})",
    "Caused by: x{n}",
    "",
    "x [Thread-{n}] y",
]
FIELDS = ("level", "request_id", "thread_name", "logger", "trace_id")


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_carry_matches_sequential_pass(spark, lines_df, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_LINES", block)
    rnd = random.Random(block)
    df = None
    expected_numbers = {}
    for src in ("a", "b", "c"):
        lines = [rnd.choice(LINES).format(n=rnd.randint(0, 9)) for _ in range(rnd.randint(20, 120))]
        expected_numbers[src] = [i + 1 for i, t in enumerate(lines) if t.strip()]
        part = lines_df(lines, src)
        df = part if df is None else df.unionByName(part)
    rows = sorted(entries_from_lines(df).collect(), key=lambda r: (r.source, r.line_number))
    for src, numbers in expected_numbers.items():
        assert [r.line_number for r in rows if r.source == src] == numbers
    ctx: dict = {}
    current = None
    for r in rows:
        if r.source != current:
            current, ctx = r.source, {}
        if r.entry_type in ("exception", "stack_trace"):
            assert tuple(r[f] for f in FIELDS) == tuple(ctx.get(f) for f in FIELDS), (r.source, r.line_number)
        else:
            for f in FIELDS:
                v = r[f]
                if (v in KNOWN_LEVELS) if f == "level" else bool(v):
                    ctx[f] = v


def test_sparse_order_keys_make_bounded_blocks(spark):
    """Microsecond keys: as many blocks as shuffle partitions, numbers and context as in one pass."""
    rnd = random.Random(5)
    rows, want = [], {}
    for src in ("hot", None):
        lines = [rnd.choice(LINES).format(n=rnd.randint(0, 9)) for _ in range(600 if src else 60)]
        at = 1_700_000_000_000_000
        for t in lines:
            at += rnd.randint(1, 9_000_000)
            rows.append((src, at, t))
        ctx, out = {}, []
        for number, (r, t) in enumerate(zip(entries_in_one_block(spark, lines), lines, strict=True), 1):
            if not t.strip():
                continue
            if r.entry_type in ("exception", "stack_trace"):
                out.append((number, *[ctx.get(f) for f in FIELDS]))
            else:
                ctx.update({f: r[f] for f in FIELDS if ((r[f] in KNOWN_LEVELS) if f == "level" else r[f])})
                out.append((number, *[r[f] for f in FIELDS]))
        want[src] = out
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, us long, raw_line string")
    got = entries_from_lines(df, order="us")
    assert 1 < got.select("block").distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = got.collect()
    for src in want:
        mine = sorted((r for r in found if r.source == src), key=lambda r: r.line_number)
        assert [(r.line_number, *[r[f] for f in FIELDS]) for r in mine] == want[src]


def entries_in_one_block(spark, lines):
    """The parsed rows of the lines themselves, without any carry."""
    from logfold.operators.parse import parse_lines

    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "source string, i long, raw_line string")
    return sorted(parse_lines(df).collect(), key=lambda r: r.i)
