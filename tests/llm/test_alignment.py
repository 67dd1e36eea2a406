"""Alignment of two tokenizers against a plain version on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logfold.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE), alignment.Chunks(A_FILE, B_FILE)


def whole(text, both):
    """(A ids, A token bytes, B ids, B token bytes) of a whole text, or None without tokens."""
    a, sp, known = both
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    bytes_a, bytes_b = [known.a_bytes[i] for i in ids_a], []
    for p in map(sp.id_to_piece, ids_b):
        bytes_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
    data = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == b"".join(bytes_b) == data else None


def spans(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def by_definition(rows, both):
    """Rows (doc_id, text) to sorted result rows, every A token compared with every B token near it."""
    found, links, total = [], [], Counter()
    for doc, text in rows:
        t = whole(text, both)
        if t is None:
            found.append((doc, 0, 0, 0, 0, ""))
            links.append([])
            continue
        a, b = spans(t[1]), spans(t[3])
        common = sorted({e for _, e in a} & {e for _, e in b})
        groups, lo = [], 0
        for hi in common:
            left = ",".join(str(i) for i, (s, e) in zip(t[0], a, strict=True) if lo <= s and e <= hi)
            right = ",".join(str(i) for i, (s, e) in zip(t[2], b, strict=True) if lo <= s and e <= hi)
            groups.append(left + "|" + right)
            lo = hi
        mine = [(i, j) for i, (s, e) in zip(t[0], a, strict=True) for j, (u, v) in zip(t[2], b, strict=True) if s < v and u < e]
        total.update(mine)
        links.append(mine)
        found.append((doc, len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, j), n in total.items():
        top[j] = max(top[j], n)
    return sorted(repr((*f, sum(total[x] == top[x[1]] for x in m), sum(total[x] for x in m))) for f, m in zip(found, links, strict=True))


ODD = [None, "", " ", "  ", "\n", "\n\n", "a", "a ", " a", "a  b", "a\n\n b\t c \n", "x\r\ny", "x\t y", "x\t\t y", "x \t\ny", "foo　bar baz\xa0 q",
       "<|endoftext|> <s></s> <unk><0x41> </s>", "▁ marked", "mid▁dle word", "Übergrößenträger 😀😀 ẞ", "\x00 nul \x00", "\x1c fs \x1d",
       "日本語のテキスト 日本語", "aaaa" * 300, "' 's 'll don't we'll  're", "1234567 89 0.5e-3", "a\x85 b", "᠎ x ​ y", "é é ﬁ Ａ"]


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum)) for r in df.collect())


def test_every_document(spark, docs, doc_rows, both, monkeypatch):
    short = sorted(doc_rows, key=lambda r: len(r.text or ""))[:120]
    df = spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string")
    assert rows_of(alignment.align_documents(df, A_FILE, B_FILE)) == by_definition([(r.doc_id, r.text) for r in short], both)


def test_odd_texts_by_broadcast_and_by_join(spark, both):
    rows = list(enumerate(ODD)) + [(None, "the same text"), (3, "the same text"), (3, "the same text"), (99, "the end of the text")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pairs string, row int").repartition(3)
    want = by_definition(rows, both)
    assert rows_of(alignment.align_documents(df, A_FILE, B_FILE)) == want
    assert rows_of(alignment.align_documents(df, A_FILE, B_FILE, max_broadcast=0)) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for bound in (0, 100):
        assert alignment.align_documents(none, A_FILE, B_FILE, max_broadcast=bound).collect() == []


def test_chunks_give_the_tokens_of_whole_texts(both):
    rnd = random.Random(4)
    parts = [" ", " ", " ", "\n", "\n", "\t", "\r", "\xa0", "　", "\x1f", "\x85", " ", "᠎", "the", "word", "ing", "'s", "!", "12", "é", "日本",
             "😀", "(", "...", "_", "Ǆ", "́", "<s>", "-"]
    assert both[2].cut
    for _ in range(4000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 25)))
        t, chunks = whole(text, both), both[2].tokens(both[2].learn([text])[0], text)
        for k in (0, 1):
            assert np.frombuffer(b"".join([c[k] for c in chunks]), "<u4").tolist() == t[2 * k], repr(text)


def test_galloping_meets_every_common_end():
    rnd = random.Random(8)
    for _ in range(500):
        a = sorted(rnd.sample(range(400), rnd.randint(0, 60)))
        b = sorted(rnd.sample(range(400), rnd.choice([0, 1, 5, 60, 300])))
        i, j = alignment.common_ends(a, b)
        assert [a[x] for x in i] == [b[x] for x in j] == sorted(set(a) & set(b))


def test_runs_and_caches_change_nothing(both, monkeypatch, doc_rows):
    text = max((r.text for r in doc_rows if r.text), key=len) + " " + "z" * 3000 + "\n" + " ".join(ODD[4:])[:900].replace("▁", "")
    want = next(alignment.align_texts([text], both[2]))
    monkeypatch.setattr(alignment, "RUN_CHUNKS", 7)
    monkeypatch.setattr(alignment, "TASK_PAIRS", 11)
    monkeypatch.setattr(alignment, "CACHE_BYTES", 20_000)
    small = alignment.Chunks(A_FILE, B_FILE)
    _, got, _, again = alignment.align_texts([None, text, "", text], small)
    assert got[:5] == again[:5]
    assert got[:5] == want[:5] and all(np.array_equal(x, y) for x, y in zip(got[5:], want[5:], strict=True))
    assert want[0] > 1000
    small.learn(["one more text"])
    assert small.held < 20_000


def test_repeated_chunks_are_aligned_once(both, monkeypatch):
    ends, real = [], alignment.common_ends
    monkeypatch.setattr(alignment, "common_ends", lambda a, b: ends.append(len(a)) or real(a, b))
    texts = [" ".join(["some words", "come often", "here\nand there"] * k) for k in range(1, 60)]
    small = alignment.Chunks(A_FILE, B_FILE)
    found = list(alignment.align_texts(texts, small))
    assert sum(ends) < 30 < 1000 < sum(f[0] for f in found)
    again = list(alignment.align_texts(texts, small))
    assert [f[:5] for f in again] == [f[:5] for f in found] and sum(ends) < 30


def test_chunks_whose_tokens_fit_only_as_a_whole(both):
    text = "one odd chunk, and\nothers around it"
    want = next(alignment.align_texts([text], alignment.Chunks(A_FILE, B_FILE)))
    small = alignment.Chunks(A_FILE, B_FILE)
    cuts = small.learn([text])[0]
    ids = [np.frombuffer(x, "<u4").tolist() for x in small.tokens(cuts, text)[1]]
    small.odd[cuts[1]] = (b" odd", b" odd"), ids
    got = alignment.align_text(text, cuts, small)
    assert got[:5] == want[:5] and all(np.array_equal(x, y) for x, y in zip(got[5:], want[5:], strict=True))
    small.odd[cuts[1]] = (b" odd", b" od"), ids
    assert alignment.align_text(text, cuts, small)[:5] == (0, 0, 0, 0, "")
