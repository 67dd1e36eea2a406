"""Quotation linking on hand-made conversations and against a sequential pass."""

from __future__ import annotations

import random

from logfold.llm import quotes


def test_nested_levels_and_attribution():
    own, _, quoted, runs = quotes.parse_message("On Monday X wrote:\n> > deep\n>> deep two\n> mid  Line\nAnswer one\n\nAnswer two\n > tail")
    assert own == "Answer one\n\nAnswer two" and runs == 3
    assert {(r, level) for r, level, _, _ in quoted} == {(0, 2), (1, 1), (2, 1)}
    assert quotes.parse_message("no quotes\nX wrote:\n")[0] == "no quotes\nX wrote:\n"


ROWS = [
    (1, 0, "user", "How do I sort?\nPlease help."),
    (1, 1, "assistant", "Use sorted."),
    (1, 2, "user", "Something else entirely."),
    (1, 3, "assistant", "> how do i  SORT?\n> please help.\nOr list.sort."),
    (1, 4, "user", "> > How do I sort?\n> Or list.sort.\nThanks"),
    (1, 5, "user", "> never said\nHm"),
    (2, 0, "user", "How do I sort?"),
    (2, 1, "user", "> How do I sort?"),
    (2, 1, "user", "> How do I sort?"),
    (3, 0, "user", "> quote of a later one\nfirst"),
    (3, 1, "user", "quote of a later one"),
    (None, 0, "user", "a"), (None, 1, "user", "> a"), (4, None, "user", None), (5, 0, None, ""),
]


def test_replies_follow_their_originals(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, position int")
    got = quotes.reply_ordered(df.repartition(4)).collect()
    assert len(got) == len(ROWS)
    at = {(r.conv_id, r.turn): r for r in got}
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 3, 4, 1, 2, 5]
    assert at[1, 3].parent_turn == 0 and at[1, 3].text == "Or list.sort." and at[1, 3].n_linked == 1
    assert at[1, 4].parent_turn == 3 and at[1, 4].thread_turn == 0 and at[1, 4].n_quotes == 2 and at[1, 4].n_linked == 2
    assert at[1, 5].parent_turn is None and at[1, 5].n_quotes == 1
    assert at[2, 1].parent_turn == 0 and at[2, 1].text == "" and at[2, 0].parent_turn is None
    assert at[3, 0].parent_turn is None and at[None, 1].parent_turn is None and at[4, None].text is None
    for conv in (1, 2, 3, None):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(sum(r[0] == conv for r in ROWS)))


def test_long_conversation_and_empty_table(spark):
    rows = [(7, t, "u", f"message number {t}" if t % 3 else f"> message number {t - 2}\nreply {t}" if t else "start") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.reply_ordered(df.repartition(5)).collect()}
    for t in range(3, 600, 3):
        assert got[t].parent_turn == t - 2 and got[t].position == got[t - 2].position + 1
    assert sorted(r.position for r in got.values()) == list(range(600))
    assert quotes.reply_ordered(df.where("turn < 0")).collect() == []


def test_messages_without_quotes_keep_their_text(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = quotes.reply_ordered(df)
    assert got.select("conv_id", "turn", "role", "text").exceptAll(df.select("conv_id", "turn", "role", "text")).count() == 0
    assert got.where("position <> turn").count() == 0


def test_rewrapped_quote_of_some_paragraphs(spark):
    first = "The first paragraph is\nwritten in two lines.\n\nThe second one has a\nline break elsewhere.\n\nThe third is never quoted."
    reply = "> The first paragraph\n> is written\n> in two lines.\n>\n> The second one\n> has a line break elsewhere.\n\nI agree.\nWholly."
    nested = "> > The second one has\n> > a line break\n> > elsewhere.\n> >\n> > never said\n>\n> I agree. Wholly.\n\nSo do I\n> hm\nin part"
    rows = [(1, 0, "u", first), (1, 1, "u", "Between."), (1, 2, "u", reply), (1, 3, "u", nested),
            (1, 4, "u", "> The second one has a line\n> break, says nobody\n>\n> nor this\nNo link."),
            (1, 5, "u", "> So do\n> I\n>\n> something else\nA part between quotes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.reply_ordered(df).collect()}
    assert got[2].parent_turn == 0 and got[2].thread_turn == 0 and got[2].n_linked == got[2].n_quotes == 1
    assert got[3].parent_turn == 2 and got[3].thread_turn == 0 and got[3].n_linked == 2
    assert got[4].parent_turn is None and got[5].parent_turn == 3
    assert [r.turn for r in sorted(got.values(), key=lambda r: r.position)] == [0, 2, 3, 5, 1, 4]
    passages = quotes.parse_message(reply)[2]
    assert quotes._hash("the second one has a line break elsewhere.") in {h for *_, h in passages}


def sequential(rows):
    """Rows (turn, text) of one conversation, turns unique: (turn, parent, thread) in reply order, by one plain pass."""
    parent, seen = {}, []
    for turn, text in sorted(rows):
        own, passages, quoted, _ = quotes.parse_message(text)
        best = None
        for _, level, chars, h in quoted:
            holders = [t for t, have in seen if h in have]
            if holders:
                best = max(best or (-99, 0, -1), (-level, chars, max(holders)))
        parent[turn] = best[2] if best else None
        seen.append((turn, set(passages)))
    out = []

    def read(turn, thread):
        out.append((turn, parent[turn], thread))
        for t in sorted(t for t, p in parent.items() if p == turn):
            read(t, thread)

    for turn in sorted(parent):
        if parent[turn] is None:
            read(turn, turn)
    return out


def test_generated_conversations_against_a_sequential_pass(spark):
    rnd = random.Random(12)
    words = "sort list file error retry cache index query token stream".split()
    rows, want = [], {}
    for conv in range(40):
        texts = []
        for turn in range(rnd.choice([1, 4, 12, 40])):
            own = [" ".join(rnd.choices(words, k=rnd.choice([1, 3, 6]))) if rnd.random() < 0.9 else "ok" for _ in range(rnd.randint(1, 3))]
            lines = []
            for _ in range(rnd.choice([0, 1, 1, 2]) if texts else 0):
                source = rnd.choice(texts).split("\n")
                lo = rnd.randrange(len(source))
                lines += ["> " * rnd.choice([1, 1, 2]) + x for x in source[lo:lo + rnd.randint(1, 3)]]
                if rnd.random() < 0.5:
                    lines.append(own.pop() if len(own) > 1 else "")
            texts.append("\n".join(lines + own))
        rows += [(conv, t, "u", x) for t, x in enumerate(texts)]
        want[conv] = sequential(list(enumerate(texts)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {}
    for r in sorted(quotes.reply_ordered(df).collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append((r.turn, r.parent_turn, r.thread_turn))
    assert got == want
    assert sum(p is not None for part in want.values() for _, p, _ in part) > 100


def test_answers_come_before_later_messages(spark):
    rows = [(1, 0, "u", "The very first question"), (1, 1, "u", "> The very first question\nan answer to it"),
            (1, 2, "u", "> The very first question\nanother answer"), (1, 3, "u", "> an answer to it\nthanks a lot"),
            (1, 4, "u", "one line\nok\nthe end of it"), (1, 5, "u", "ok"), (1, 6, "u", "> ok\nfine by me"),
            (1, 7, "u", "ok"), (1, 8, "u", "> ok\nfine by me too")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(quotes.reply_ordered(df).collect(), key=lambda r: r.position)
    assert [r.turn for r in got] == [0, 1, 3, 2, 4, 5, 6, 7, 8]
    assert {r.turn: r.parent_turn for r in got} == {0: None, 1: 0, 2: 0, 3: 1, 4: None, 5: None, 6: 5, 7: None, 8: 7}


def test_one_passage_in_very_many_messages(spark, monkeypatch):
    """A passage that all messages hold and quote spreads over partitions; each links to the message before it."""
    rows = [(1, t, "u", "the common line here" if t % 2 == 0 else f"> the common line here\nreply {t} of them") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    want = [(t + k, t if k else None) for t in range(0, 400, 2) for k in (0, 1)]
    for bound in (quotes.MAX_BROADCAST, 0):
        monkeypatch.setattr(quotes, "MAX_BROADCAST", bound)
        got = sorted(quotes.reply_ordered(df).collect(), key=lambda r: r.position)
        assert [(r.turn, r.parent_turn) for r in got] == want


def test_very_long_text(spark):
    long = "\n".join(f"line {i} of a very long message" for i in range(20_000))
    rows = [(1, 0, "u", long), (1, 1, "u", "> line 19999 of a very long message\nyes it is")]
    got = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].parent_turn == 0 and got[0].text == long
