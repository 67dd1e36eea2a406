"""Sampled segmentations: distinct, decodable, seeded by key, and distributed as the lattice says."""

from __future__ import annotations

import math
from collections import Counter

import public_tokenizers
import pytest

from logfold.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(MODEL)


def leaves(lattice, text):
    """Every segmentation with its log probability, by plain recursion."""
    out = [((), 0.0)]
    for word in pieces._WORDS.findall(lattice.sp.normalize(text)):
        table = lattice.word(word)

        def walk(i, ids, logp, table=table, n=len(word)):
            if i == n:
                yield ids, logp
                return
            for j, more, cond in table[i]:
                yield from walk(j, ids + more, logp + cond)

        out = [(a + b, x + y) for a, x in out for b, y in walk(0, (), 0.0)]
    return dict(out)


def test_probabilities_sum_to_one_and_samples_are_leaves(lattice):
    for text in ("abc", "the cat", "a€b", "x"):
        every = leaves(lattice, text)
        assert math.fsum(map(math.exp, every.values())) == pytest.approx(1)
        got = lattice.sample(text, 50, "k")
        assert len(got) == min(50, len(every)) and len({tuple(g[0]) for g in got}) == len(got)
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        for ids, logp, _, inclusion in got:
            assert logp == pytest.approx(every[tuple(ids)]) and 0 < inclusion <= 1


def test_first_sample_follows_the_lattice_and_inclusion_is_unbiased(lattice):
    every = leaves(lattice, "than")
    n, first, total = 4000, Counter(), Counter()
    for s in range(n):
        got = lattice.sample("than", 3, str(s))
        first[tuple(got[0][0])] += 1
        for ids, logp, _, inclusion in got:
            total[tuple(ids)] += math.exp(logp) / inclusion
    for ids, logp in every.items():
        p = math.exp(logp)
        assert first[ids] / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 1e-9)
        if p > 0.01:
            assert total[ids] / n == pytest.approx(p, rel=0.25)


def test_round_trip_and_seeds(spark, sf):
    odd = ["", None, "  two  spaces ", "line\nbreak\ttab", "漢字 é 😀", "x" * 3000]
    rows = [(i, t, 1) for i, t in enumerate(odd + [r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").limit(40).collect()])]
    df = spark.createDataFrame(rows, "key long, text string, sample int").drop("sample")
    got = pieces.sample_segmentations(df.repartition(3), MODEL, ["key"], samples=3)
    back = pieces.decode(got, MODEL).collect()
    texts = {k: t or "" for k, t, _ in rows}
    assert {r.key for r in back} == set(texts) and all(r.text == texts[r.key] for r in back)
    again = pieces.sample_segmentations(df.coalesce(1), MODEL, ["key"], samples=3).collect()
    assert sorted((r.key, r.sample, tuple(r.ids)) for r in back) == sorted((r.key, r.sample, tuple(r.ids)) for r in again)
    empty = [r for r in back if r.key in (0, 1)]
    assert [(r.ids, r.log_prob, r.inclusion) for r in empty] == [([], 0.0, 1.0)] * 2
    assert pieces.sample_segmentations(df.where("key < 0"), MODEL, ["key"]).collect() == []


def test_encode_and_decode_are_inverse(spark):
    df = spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, "")], "id int, text string")
    ids = pieces.encode(df, MODEL)
    back = {r.id: r for r in pieces.decode(ids, MODEL, text_col="again").collect()}
    assert back[1].again == "Hello wörld" and back[2].ids is None and back[2].again is None and back[3].again == ""
    with pytest.raises(ValueError):
        pieces.encode(ids, MODEL)


def test_runs_of_spaces_have_their_pieces(lattice):
    for text in ("a\n b", "a   b", "    ", "if x:\n        y  = 1", " " * 40):
        every = leaves(lattice, text) if len(text) < 10 else None
        own = tuple(lattice.sp.encode(text))
        if every:
            assert own in every and math.fsum(map(math.exp, every.values())) == pytest.approx(1)
        at, tables = 0, [(w, lattice.word(w)) for w in pieces._WORDS.findall(lattice.sp.normalize(text))]
        for word, table in tables:  # the model's own segmentation is a path
            i = 0
            while i < len(word):
                j, ids = next((j, ids) for j, ids, _ in table[i] if own[at:at + len(ids)] == ids)
                i, at = j, at + len(ids)
        assert at == len(own)
        got = lattice.sample(text, 2, "k")
        assert len(got) == 2 and got[0][0] != got[1][0] and all(g[3] <= 1 for g in got)
        assert {lattice.sp.decode(g[0]) for g in got} == {lattice.sp.decode(list(own))}
    assert len(leaves(lattice, "   ")) == 8
    assert len(lattice.sample(" " * 100_000, 2, "k")) == 2


def test_pieces_across_words(tmp_path):
    import sentencepiece

    file = str(tmp_path / "across.model")
    with open(file, "wb") as f:
        sentencepiece.SentencePieceTrainer.train(
            sentence_iterator=iter(["of the day in the end of the week", "in the night of the day"] * 50), model_writer=f, vocab_size=40,
            split_by_whitespace=False, hard_vocab_limit=False, minloglevel=2)
    lattice = pieces.Lattice(file)
    own = lattice.sp.encode("of the day")
    assert any("▁" in lattice.sp.id_to_piece(i).lstrip("▁") for i in own)
    assert own in [g[0] for g in lattice.sample("of the day", 100_000, "k")]
