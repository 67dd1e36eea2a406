"""Packing: tokens against the plain tokenizer, a whole and gapless layout, sequence counts near the bound."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np

from logfold.llm import packing
from logfold.llm.queries import tokenizer_file

ODD = ["", None, "   \n", "Don't stop'll we've it's! <|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b", "É é x̄. … … . ß.,. K",
       "tab\tnew line x 123,456.7 AbC-dEf_(g)", "ᵃʰ 你好。 \U0001f600!! İstanbul ª.", "x" * 9000,
       "word " * 5000]


def plain(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_file()).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, capacity=4096):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = plain(text)
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(ids), capacity))
        for p in pieces:
            part = ids[p.start:p.start + capacity]
            assert p.length == len(part)
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    layout(rows, capacity)


def layout(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents_and_odd_texts(spark, doc_rows):
    texts = {r.doc_id: r.text for r in doc_rows} | {-1 - k: t for k, t in enumerate(ODD)}
    df = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id long, text string, length int")
    rows = packing.pack_documents(df.repartition(5), tokenizer_file()).collect()
    check(rows, texts)
    bound = -(-sum(r.length for r in rows) // 4096)
    assert layout(rows, 4096) <= bound + 2


def best_fit_decreasing(counts, capacity):
    gaps, opened = [], 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            at = bisect.bisect_left(gaps, n)
            opened += at == len(gaps)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            bisect.insort(gaps, gap - n)
    return opened


def rounds(counts, capacity):
    """The rounds of ``match_rounds`` in one process, over the same sweep."""
    runs, gaps, opened, moves = [(packing.RUN, n, 0, c) for n, c in counts.items()], [], 0, []
    while runs:
        largest = max((g[1] for g in gaps), default=0)
        new = -(-sum(n * left for _, n, _, left in runs if n > largest) // capacity)
        if new:
            gaps.append((packing.GAP, capacity, opened, new))
            opened += new
        out = list(packing.sweep(sorted(runs + gaps, key=lambda r: (-r[1], r[0], r[2])), capacity))
        moves += [r[1:] for r in out if r[0] == packing.MOVE]
        runs = [r[:4] for r in out if r[0] == packing.RUN]
        gaps = [r[:4] for r in out if r[0] == packing.GAP and r[1]]
    return moves


def check_moves(moves, counts, capacity):
    used, placed = {}, {n: 0 for n in counts}
    for n, rank, count, first, per, offset in sorted(moves):
        assert rank == placed[n]
        placed[n] += count
        for i in range(count):
            used.setdefault(first + i // per, []).append((offset + i % per * n, n))
    assert placed == counts
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(used)


def test_rounds_place_everything_as_tightly_as_one_by_one():
    rnd = random.Random(3)
    for capacity in (16, 100, 4096):
        for _ in range(30):
            counts = {rnd.randint(1, capacity): rnd.randint(1, 400) for _ in range(rnd.randint(1, 60))}
            assert check_moves(rounds(counts, capacity), counts, capacity) <= 1.06 * best_fit_decreasing(counts, capacity) + 1


def test_rounds_as_tables_in_one_and_several_ranges(spark):
    rnd = random.Random(5)
    counts = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(40)}
    lengths = spark.createDataFrame(list(counts.items()), "size long, many long")
    one = [tuple(r)[1:] for r in packing.match_rounds(lengths, 100).collect()]
    assert sorted(one) == sorted(rounds(counts, 100))
    several = [tuple(r)[1:] for r in packing.match_rounds(lengths, 100, runs_per_task=16).collect()]
    assert check_moves(several, counts, 100) <= 1.2 * best_fit_decreasing(counts, 100) + 1


def test_pack_keeps_columns_of_any_name(spark):
    rnd = random.Random(9)
    data = [(k, rnd.choice([1, 7, 30, 64]), "x", k) for k in range(500)]
    pieces = spark.createDataFrame(data, "at long, length long, kind string, part long").repartition(7)
    rows = packing.pack(pieces, 64).collect()
    assert sorted((r.at, r.length, r.kind, r.part) for r in rows) == data
    counts = {n: sum(d[1] == n for d in data) for n in (1, 7, 30, 64)}
    assert layout(rows, 64) <= 1.06 * best_fit_decreasing(counts, 64) + 1


def test_one_length_in_every_row_and_empty_table(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'' as text")
    rows = packing.pack_documents(df, tokenizer_file()).collect()
    assert len(rows) == 3000 and layout(rows, 4096) == 1
    assert packing.pack_documents(df.where("doc_id < 0"), tokenizer_file()).collect() == []


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, tokenizer_file()).collect()
    assert len(rows) == 4 and layout(rows, 4096) == 1


def test_each_distinct_chunk_of_a_run_is_looked_up_once():
    looked = []

    class Index(packing.ChunkIndex):
        def __getitem__(self, chunk):
            looked.append(chunk)
            return super().__getitem__(chunk)

    tokenizer = packing.ChunkTokenizer(tokenizer_file())
    tokenizer.index = Index()
    text = "Some words, again " * 500
    found = tokenizer.texts([text.encode()] * 20)
    assert sorted(looked) == [b",", b"again", b"some", b"words"]
    assert found == [np.array(plain(text)[:-1], "<u4").tobytes()] * 20


def test_runs_of_odd_texts_have_the_tokens_of_each_text(monkeypatch):
    from tokenizers import Tokenizer

    whole, rnd = Tokenizer.from_file(tokenizer_file()), random.Random(6)
    parts = [" ", " ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\xa0", "　", "word", "Word", "'S", "it's", "!", "...", "12", "é", "é", "İ",
             "<|", "|>", "<|endoftext|>", "a<|endoftext|>b", "\U0001f600", "_", "-", "\x00", "a.b"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(2000)] + [""]
    for cached in (packing.CACHE_BYTES, 500):
        monkeypatch.setattr(packing, "CACHE_BYTES", cached)
        tokenizer = packing.ChunkTokenizer(tokenizer_file())
        for lo in range(0, len(texts), 40):
            run = texts[lo:lo + 40]
            want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in run]
            assert tokenizer.texts([t.encode() for t in run]) == want
    assert tokenizer.texts([b""]) == [b""] and tokenizer.texts([b"", b" "]) == [b"", b""]
