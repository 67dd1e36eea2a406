"""Keyword rules as a table, matched in one pass over each message.

A rule names a kind, a position within it, a sentence and the keywords any of
which must occur in the lower-cased message.  Kinds: ``analyzer_pattern`` and
``analyzer_anomaly`` (keyword sentences of the analyzer), ``pattern`` and
``anomaly`` (of the detector), ``lifecycle`` (evidence lines; no sentence).

:class:`RuleSet` compiles all keywords of a rule table into one trie, written
as one regular expression inside a look-ahead: at every position of a message
it finds the longest keyword that begins there; shorter keywords that begin
there are prefixes of it, so its rules include theirs.  Each keyword stands
for the bits of its rules, so a message yields one or a few longs, and a source
the ``bit_or`` of them: the aggregation has one column for 62 rules, whatever
the number of keywords.

The table is bounded: more than ``MAX_KEYWORDS`` rows are refused with an
error.  Rows with a null kind or an unknown one are refused too; null and empty
keywords are ignored (a rule without keywords never holds); keywords are
lower-cased as messages are; repeated rows count once; a null position sorts
first, and rules of equal kind and position are ordered by sentence.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions import patterns as P

KINDS = ("analyzer_pattern", "analyzer_anomaly", "pattern", "anomaly", "lifecycle")
MAX_KEYWORDS = 1000
RULE_DDL = "kind string, position int, sentence string, keyword string"
_BITS = 62

#: The rules of the reproduced behaviour: (kind, position, sentence, keywords).
DEFAULT_RULES = (
    ("analyzer_pattern", 0, P.SENT_TIMEOUT_MESSAGES, ("timeout",)),
    ("analyzer_pattern", 1, P.SENT_RETRY_ACTIVITY, ("retry",)),
    ("analyzer_anomaly", 0, P.SENT_SHUTDOWN_EVENTS, ("shutdown",)),
    *[("pattern", i, sentence, words) for i, (sentence, words) in enumerate(P.DETECTOR_PATTERN_RULES)],
    *[("anomaly", i, sentence, words) for i, (sentence, words) in enumerate(P.DETECTOR_ANOMALY_RULES)],
    ("lifecycle", 0, "", P.LIFECYCLE_KEYWORDS),
)


def rule_table(spark: SparkSession, rules: Iterable[tuple] = DEFAULT_RULES) -> DataFrame:
    """Rules (kind, position, sentence, keywords) as a table with one row per keyword."""
    rows = [(kind, position, sentence, word) for kind, position, sentence, words in rules for word in words]
    return spark.createDataFrame(rows, RULE_DDL)


def _escaped(ch: str) -> str:
    return ch if ch.isascii() and ch.isalnum() else f"\\x{{{ord(ch):x}}}"


def trie_regex(words: Iterable[str]) -> str:
    """A regular expression for the longest of ``words`` (not empty) at a position, branching character by character."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}  # a word ends here

    def written(node: dict) -> str:
        branches = []
        for ch in sorted(k for k in node if k):
            text, child = _escaped(ch), node[ch]
            while len(child) == 1 and "" not in child:  # a chain without branches
                (ch, child), = child.items()
                text += _escaped(ch)
            branches.append(text + (written(child) if len(child) > ("" in child) else ""))
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return written(root)


def _first(words: Iterable[str]) -> str:
    """A look-ahead for the first characters of ``words``: most positions fail at this one test."""
    return "(?=[" + "".join(map(_escaped, sorted({w[0] for w in words}))) + "])"


def _joined_bits(words: Column, known: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(words, zero, lambda acc, w: acc.bitwiseOR(F.element_at(known, w))), zero)


@dataclass(frozen=True)
class RuleSet:
    """Compiled rules, ordered by kind, position and sentence."""

    rules: tuple[tuple[str, int | None, str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, rules: DataFrame | RuleSet | None) -> RuleSet:
        """The rules of a table; the default ones for None."""
        if rules is None:
            return _DEFAULT
        if isinstance(rules, RuleSet):
            return rules
        lowered = rules.select("kind", "position", "sentence", F.lower("keyword").alias("keyword")).distinct()
        rows = lowered.limit(MAX_KEYWORDS + 1).collect()
        if len(rows) > MAX_KEYWORDS:
            raise ValueError(f"more than {MAX_KEYWORDS} keyword rules")
        words: dict[tuple, set[str]] = {}
        for r in rows:
            words.setdefault((r.kind, r.position, r.sentence or ""), set()).add(r.keyword or "")
        return cls.build([(*key, sorted(found - {""})) for key, found in words.items()])

    @classmethod
    def build(cls, rules: Iterable[tuple]) -> RuleSet:
        """From (kind, position, sentence, lower-case keywords)."""
        rules = [(kind, position, sentence, tuple(words)) for kind, position, sentence, words in rules]
        unknown = sorted({str(r[0]) for r in rules} - set(KINDS))
        if unknown:
            raise ValueError(f"unknown kinds of rules: {', '.join(unknown)}")
        return cls(tuple(sorted(rules, key=lambda r: (KINDS.index(r[0]), -1 if r[1] is None else r[1], r[2]))))

    def _keywords(self, kinds: tuple[str, ...]) -> dict[str, int]:
        """Keyword to the bits of its rules, those of its prefixes included."""
        bits: dict[str, int] = {}
        for i, (kind, _, _, words) in enumerate(self.rules):
            if kind in kinds:
                for w in words:
                    bits[w] = bits.get(w, 0) | 1 << i
        return {w: reduce(or_, (bits.get(w[:k], 0) for k in range(1, len(w) + 1))) for w in bits}

    def masks(self, lowered: Column, kinds: tuple[str, ...] = KINDS) -> list[Column]:
        """One long per 62 rules: the bits of the rules of ``kinds`` that hold for a lower-cased message (0 for null)."""
        bits = self._keywords(kinds)
        if not bits:
            return []
        found = F.regexp_extract_all(lowered, F.lit(f"{_first(bits)}(?=({trie_regex(bits)}))"), F.lit(1))
        out = []
        for lo in range(0, len(self.rules), _BITS):
            part = {w: b >> lo & (1 << _BITS) - 1 for w, b in bits.items()}
            known = F.create_map(*[F.lit(x) for w, b in part.items() for x in (w, b)]).cast("map<string,bigint>")
            out.append(_joined_bits(found, known))
        return out

    def holds(self, lowered: Column, kind: str) -> Column:
        """Whether any rule of ``kind`` holds for a lower-cased message; false for null."""
        words = self._keywords((kind,))
        return F.coalesce(lowered.rlike(_first(words) + trie_regex(words)), F.lit(False)) if words else F.lit(False)

    def sentences(self, kind: str, masks: list[Column]) -> Column:
        """The sentences of the rules of ``kind`` whose bits are set, in order, as an array (empty for null masks)."""
        items = [F.when(masks[i // _BITS].bitwiseAND(1 << i % _BITS) != 0, F.lit(sentence))
                 for i, (k, _, sentence, words) in enumerate(self.rules) if k == kind and words and masks]
        return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


_DEFAULT = RuleSet.build(DEFAULT_RULES)
