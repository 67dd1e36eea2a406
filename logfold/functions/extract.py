"""Column expressions that classify a log line and pull typed fields out of it.

Every function takes and returns a ``Column`` built from Spark SQL built-ins
(regexp_extract / regexp_replace / rlike / try_make_timestamp_ntz ...), so the
whole parse runs inside whole-stage code generation with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfold.functions.patterns import (
    COMPONENT_TOKENS,
    D,
    LEVEL_ALT,
    LOGGER_SKIP_WORDS,
    MONTHS,
    WB_AFTER,
    WB_BEFORE,
    WORD,
    WS,
)

WS_CHARS = WS[1:-1]  # the class body, for use inside other classes

# --- timestamp shapes -------------------------------------------------------
_HMS = rf"{D}{{2}}:{D}{{2}}:{D}{{2}}"
TS_ISO = rf"{D}{{4}}-{D}{{2}}-{D}{{2}}[ T]{_HMS}(?:[.,]{D}+)?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"
TS_SLASH = rf"{D}{{4}}/{D}{{2}}/{D}{{2}}[ T]{_HMS}(?:[.,]{D}+)?"
TS_DAYFIRST = rf"{D}{{2}}-{D}{{2}}-{D}{{4}}[ T]{_HMS}(?:[.,]{D}+)?"
TS_ACCESS = rf"{D}{{2}}/{WORD}{{3}}/{D}{{4}}:{_HMS}"
TS_SEARCH = rf"({TS_ISO}|{TS_SLASH}|{TS_DAYFIRST}|{TS_ACCESS})"
TS_PREFIX = rf"^(?:{TS_ISO}|{TS_SLASH}|{TS_DAYFIRST})(?:{WS}+)?"

# One anchored pattern that splits any found timestamp into its pieces; each
# shape has its own groups: ISO (1-7, also the structured form whose date and
# time are separated by any whitespace run), slash (8-14), day-first (15-21),
# access (22-27).
_P2 = rf"({D}{{2}})"
_TIME_PIECES = rf"{_P2}:{_P2}:{_P2}"
TS_PIECES = (
    rf"^(?:({D}{{4}})-{_P2}-{_P2}(?:[ T]|{WS}+){_TIME_PIECES}(?:[.,]({D}+))?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"
    rf"|({D}{{4}})/{_P2}/{_P2}[ T]{_TIME_PIECES}(?:[.,]({D}+))?"
    rf"|{_P2}-{_P2}-({D}{{4}})[ T]{_TIME_PIECES}(?:[.,]({D}+))?"
    rf"|{_P2}/({WORD}{{3}})/({D}{{4}}):{_TIME_PIECES})$"
)
TS_PIECE_COUNT = 27

# --- line shapes ------------------------------------------------------------
LEVEL_GROUP = rf"(?:{LEVEL_ALT})"
# Level searches run on the case-folded line (see fold_case): case-sensitive
# and lower case, which Java matches much faster than (?iu), and equal to a
# case-insensitive search on the line itself.
_LEVEL_ALT_LOWER = LEVEL_ALT.lower()
BRACKET_LEVEL_FOLDED = rf"^\[({_LEVEL_ALT_LOWER})\]"
LEVEL_SEARCH_FOLDED = rf"{WB_BEFORE}({_LEVEL_ALT_LOWER}){WB_AFTER}"
LATER_LEVEL_FOLDED = rf"{WS}+{WB_BEFORE}(?:{_LEVEL_ALT_LOWER}){WB_AFTER}"

STRUCTURED = (
    rf"(?iu)^\[({LEVEL_ALT})\]{WS}*"
    rf"\[({D}{{4}}-{D}{{2}}-{D}{{2}}{WS}+{D}{{2}}:{D}{{2}}:{D}{{2}}(?:,{D}+)?)\]{WS}*"
    rf"\[([^\]]+)\]{WS}*"
    rf"T:(.+?){WS}+-{WS}+R:"
    rf"([^{WS_CHARS}\[]*){WS}*"
    rf"(?:\[([^\]]+)\]:?{WS}*)?"
    rf"(.*)$"
)
ACCESS = (
    rf"^({D}+\.{D}+\.{D}+\.{D}+){WS}+-{WS}+-{WS}+-{WS}+"
    rf"({TS_ACCESS}){WS}+[+-]{D}{{4}}{WS}+"
    rf'"({WORD}+){WS}+([^"]+){WS}+HTTP/[^"]+"{WS}+({D}+)(?:{WS}+({D}+))?'
)
STACK_START = rf"^(?:{WS}+at{WS}+|Caused by:|\t)"
EXCEPTION_LINE = rf"(?iu)^[a-z][\p{{L}}\p{{N}}_.$]*(?:Exception|Error)(?::{WS}.*)?$"

BRACKET_TOKEN = r"\[([^\]]+)\]"
LOGGER_IDENT = r"^[A-Za-z][A-Za-z0-9_$]*$"
LOGGER_DOTTED = r"^[A-Za-z0-9_.]+$"
LOGGER_WORD = r"(?:\[)?([A-Za-z0-9_.-]+(?:Logger|LOGGER|loger|logger))(?:\])?"

THREAD_KEY = rf"(?iu)thread(?:{WS}*name)?(?:{WS}*[:=]|{WS}*\[){WS}*([A-Za-z0-9_.-]+)"
THREAD_BRACKET = r"(?iu)\[(Thread[^\]]*)\]"
THREAD_POOL = r"(?iu)\[((?:pool|hystrix|dw)-[^\]]+)\]"

TRACE_REF = rf"{WB_BEFORE}T:([^{WS_CHARS}-]+)"
REQUEST_REF = rf"{WB_BEFORE}R:([^{WS_CHARS}\[]+)"
REQUEST_KEYS = (
    r"(?iu)request[_-]?id[:= ]+([A-Za-z0-9-]+)",
    r"(?iu)trace[_-]?id[:= ]+([A-Za-z0-9-]+)",
    r"(?iu)session[_-]?id[:= ]+([A-Za-z0-9-]+)",
    rf"{WB_BEFORE}REQ[-_]?([A-Z0-9]+){WB_AFTER}",
)
UUID = (
    rf"{WB_BEFORE}([0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-"
    rf"[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}){WB_AFTER}"
)

CLEAN_LEADING_BRACKETS_LEVEL = (
    rf"(?iu)^(?:\[[^\]]+\]{WS}*)+(?:[A-Z_]+{WS}+)?{LEVEL_GROUP}{WS}*[:\-]?{WS}*"
)
CLEAN_ONE_BRACKET = rf"^\[[^\]]+\]{WS}*"
CLEAN_LEVEL_BRACKET = (
    rf"(?iu)^(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|CRITICAL|FATAL){WS}+\[[^\]]+\]{WS}*"
)

# The characters of WS (Python's str.isspace() set) as a literal string for btrim.
WS_STRING = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace (and \\x1c-\\x1f) at both ends."""
    return F.btrim(col_(c), F.lit(WS_STRING))


def nonempty(c: Column) -> Column:
    """'' -> NULL, so that Python truthiness rules become SQL null rules."""
    return F.nullif(c, F.lit(""))


def find(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` anywhere in the value (search semantics); NULL if none."""
    return nonempty(F.regexp_extract(col_(c), pattern, group))


def groups(c: Column | str, pattern: str, n: int) -> Column:
    """Run ``pattern`` (anchored at the start) once and capture all ``n`` groups.

    Lines never contain a newline (it is a line separator), so one
    ``regexp_replace`` writes ``\\n<g1>\\n<g2>...`` and ``split`` turns it into
    an array: one regex evaluation instead of one per group.  The array has
    ``n + 1`` elements when the pattern matched and one element otherwise;
    read it with :func:`matched` and :func:`group` after materialising it as
    a column (so the regex is not re-evaluated per use).
    """
    pat = pattern
    flags = ""
    if pat.startswith("(?"):
        flags, pat = pat[: pat.index(")") + 1], pat[pat.index(")") + 1 :]
    if not pat.startswith("^"):
        pat = "^" + pat
    if not pat.endswith("$"):
        pat = "^(?:" + pat[1:] + ").*$"
    repl = "".join(f"\n${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(col_(c), flags + pat, repl), "\n")


def matched(arr: Column) -> Column:
    return F.size(arr) > 1


def group(arr: Column, i: int) -> Column:
    """Group ``i`` (1-based) of a :func:`groups` array; NULL when the pattern did not match."""
    return F.try_element_at(arr, F.lit(i + 1))


def normalize_level(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up == "WARN", F.lit("WARNING")).otherwise(up)


# --- timestamps -----------------------------------------------------------------

def _int(c: Column) -> Column:
    return c.try_cast("int")


def timestamp_from_pieces(y: Column, mo: Column, d: Column, h: Column, mi: Column,
                          s: Column, frac: Column) -> Column:
    """Calendar-checked TIMESTAMP_NTZ from text pieces, NULL when any piece is invalid.

    Seconds 60 and year 0 are rejected explicitly (make_timestamp would accept
    them); a fraction longer than six digits is rejected; shorter ones are
    right-padded (``,789`` is 789000 microseconds).
    """
    frac = F.coalesce(nonempty(frac), F.lit(""))
    secs = F.concat(s, F.lit("."), F.rpad(frac, 6, "0")).try_cast("decimal(8,6)")
    ok = (
        (_int(y) >= 1) & (_int(h) < 24) & (_int(mi) < 60) & (_int(s) < 60)
        & (F.length(frac) <= 6)
    )
    return F.when(ok, F.try_make_timestamp_ntz(_int(y), _int(mo), _int(d), _int(h), _int(mi), secs))


def timestamp_pieces(v: Column) -> Column:
    """Array of the 27 groups of :data:`TS_PIECES` for a timestamp text; NULL if no shape fits."""
    return groups(v, TS_PIECES, TS_PIECE_COUNT)


def _month_number(name: Column) -> Column:
    # Month names are matched case-insensitively, but every capital T was
    # replaced by a space before parsing, so a name such as "OCT" fails.
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))
    return F.when(~name.contains("T") & (pos > 0), pos.cast("string"))


def timestamp_from_pieces_array(p: Column) -> Column:
    """TIMESTAMP_NTZ from the output of :func:`timestamp_pieces` (materialise ``p`` first)."""
    def g(i: int) -> Column:
        return nonempty(group(p, i))

    y = F.coalesce(g(1), g(8), g(17), g(24))
    mo = F.coalesce(g(2), g(9), g(16), _month_number(g(23)))
    d = F.coalesce(g(3), g(10), g(15), g(22))
    h = F.coalesce(g(4), g(11), g(18), g(25))
    mi = F.coalesce(g(5), g(12), g(19), g(26))
    s = F.coalesce(g(6), g(13), g(20), g(27))
    fr = F.coalesce(g(7), g(14), g(21))
    return F.when(matched(p), timestamp_from_pieces(y, mo, d, h, mi, s, fr))


def parse_timestamp_text(v: Column) -> Column:
    """Parse one timestamp text (found, structured or access form); NULL if invalid."""
    return timestamp_from_pieces_array(timestamp_pieces(v))


def find_timestamp_text(line: Column) -> Column:
    """Text of the leftmost timestamp in the line (every shape contains ':')."""
    return F.when(line.contains(":"), find(line, TS_SEARCH))


def extract_timestamp(line: Column) -> Column:
    """Leftmost timestamp anywhere in the line; only that first candidate is tried."""
    return parse_timestamp_text(find_timestamp_text(line))


def iso_text(ts: Column) -> Column:
    """``datetime.isoformat()``: no fraction when it is zero, else six digits."""
    # The text of a zone-less timestamp does not pass through the session's zone, as date_format would.
    text = F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


# --- generic fields ----------------------------------------------------------
#
# Each extractor takes the stripped line and ``fold``, a case-folded copy used
# only for cheap ``contains`` guards: a regex runs only on lines that contain
# the literal it needs.  ``fold`` maps every character that matches an ASCII
# letter case-insensitively (including dotless i, dotted I, long s and the
# Kelvin sign) to that letter, so a guard can only be too permissive, never
# skip a line the regex would match.

def fold_case(line: Column) -> Column:
    """Lower case, with dotted I, dotless i and long s mapped to ASCII first
    (dotted I would lower-case to two characters).  Same length as ``line``
    and aligned with it character by character."""
    return F.translate(F.lower(F.translate(line, "\u0130\u0131\u017f", "iis")), "\u0131", "i")


def _any(c: Column, words) -> Column:
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


def _fold(line: Column, fold: Column | None) -> Column:
    return fold if fold is not None else fold_case(line)


LEVEL_HINTS = ("debug", "info", "warn", "error", "critical", "fatal", "trace")

def has_level_word(line: Column, fold: Column | None = None) -> Column:
    """Cheap superset test for 'a level word may occur in the line'."""
    return _any(_fold(line, fold), LEVEL_HINTS)


def extract_level(line: Column, fold: Column | None = None) -> Column:
    """Bracketed level at the start, else the leftmost whole-word level.

    Matched on the folded line, which equals a case-insensitive match on the
    line itself (the fold maps exactly the characters that match an ASCII
    letter case-insensitively) and keeps word boundaries in place.
    """
    f = _fold(line, fold)
    found = F.coalesce(find(f, BRACKET_LEVEL_FOLDED), find(f, LEVEL_SEARCH_FOLDED))
    return F.when(has_level_word(line, f), normalize_level(found))


def extract_logger(line: Column, fold: Column | None = None) -> Column:
    cands = F.transform(F.regexp_extract_all(line, F.lit(BRACKET_TOKEN), 1), ustrip)
    skip = [F.lit(w) for w in LOGGER_SKIP_WORDS]
    good = F.filter(
        cands,
        lambda x: (x != "")
        & ~F.lower(x).isin(*skip)
        & (x.rlike(LOGGER_IDENT) | (x.contains(".") & x.rlike(LOGGER_DOTTED))),
    )
    bracketed = F.when(line.contains("["), F.try_element_at(good, F.lit(1)))
    word = F.when(_any(line, ("ogger", "OGGER", "loger")), find(line, LOGGER_WORD))
    return F.coalesce(bracketed, word)


def extract_thread(line: Column, fold: Column | None = None) -> Column:
    f = _fold(line, fold)
    has_thread = f.contains("thread")
    bracket = line.contains("[")
    return F.coalesce(
        F.when(has_thread, find(line, THREAD_KEY)),
        F.when(bracket & has_thread, find(line, THREAD_BRACKET)),
        F.when(bracket & _any(f, ("pool-", "hystrix-", "dw-")), find(line, THREAD_POOL)),
    )


def extract_trace(line: Column, fold: Column | None = None) -> Column:
    t = F.when(line.contains("T:"), find(line, TRACE_REF))
    return F.when(t != "_default_", t)


def extract_component(line: Column, fold: Column | None = None) -> Column:
    f = _fold(line, fold)
    return F.coalesce(*[
        F.when(f.contains(tok.lower()), find(line, rf"(?iu){tok}[:= ]+([A-Za-z0-9_.-]+)"))
        for tok in COMPONENT_TOKENS
    ])


def request_ref(line: Column) -> Column:
    """Stripped ``R:`` reference text ('' when absent); materialise it, it is read thrice."""
    return F.when(line.contains("R:"), ustrip(F.regexp_extract(line, REQUEST_REF, 1))).otherwise(F.lit(""))


def _count_char(line: Column, ch: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(ch), F.lit("")))


def extract_request_id(line: Column, fold: Column | None = None, ref: Column | None = None) -> Column:
    f = _fold(line, fold)
    ref = ref if ref is not None else request_ref(line)
    ref = F.when((ref != "") & (ref != "_default_"), ref)
    guards = (f.contains("request"), f.contains("trace"), f.contains("session"), line.contains("REQ"))
    keyed = [F.when(g, find(line, p)) for g, p in zip(guards, REQUEST_KEYS)]
    return F.coalesce(ref, *keyed, F.when(_count_char(line, "-") >= 4, find(line, UUID)))


def first_char_is_digit(c: Column) -> Column:
    return F.substring(c, 1, 1).rlike(rf"^{D}$")


# Message cleaning as four steps; the parse materialises each step as a column
# (each step reads its input several times), clean_message composes them.

def message_step1(line: Column) -> Column:
    """Drop a leading timestamp (it can only start with a digit)."""
    return ustrip(F.when(first_char_is_digit(line), F.regexp_replace(line, TS_PREFIX, "")).otherwise(line))


def message_step2(m: Column) -> Column:
    """Drop a leading bracket run + optional word + level, then one leading bracket."""
    both = F.regexp_replace(F.regexp_replace(m, CLEAN_LEADING_BRACKETS_LEVEL, ""), CLEAN_ONE_BRACKET, "")
    return F.when(m.startswith("["), both).otherwise(m)


def message_step3(m: Column) -> Column:
    """Drop a leading ``LEVEL [x]``."""
    return F.when(m.contains("["), F.regexp_replace(m, CLEAN_LEVEL_BRACKET, "")).otherwise(m)


def message_step4(m: Column, level_hint: Column) -> Column:
    """Cut from the first "whitespace + level word" to the end of the line.

    The position is found on the folded text, which is aligned with ``m``
    character by character (fold_case keeps lengths).
    """
    kept = F.length(F.regexp_replace(fold_case(m), LATER_LEVEL_FOLDED + ".*$", ""))
    return ustrip(F.when(level_hint, F.substring(m, F.lit(1), kept)).otherwise(m))


def clean_message(line: Column, fold: Column | None = None) -> Column:
    """Five ordered rewrites; the last cuts from the first later level word to the end."""
    m = message_step3(message_step2(message_step1(line)))
    return message_step4(m, has_level_word(line, fold))


# --- line kinds ---------------------------------------------------------------

def is_continuation(raw_line: Column, stripped: Column, fold: Column | None = None,
                    exception_line: Column | None = None) -> Column:
    """Stack frame / exception / 'Caused by' test; ``raw_line`` is the unstripped line."""
    exc = exception_line if exception_line is not None else is_exception_line(stripped, fold)
    lead_ws = F.instr(F.lit(WS_STRING), F.substring(raw_line, 1, 1)) > 0
    stack = raw_line.startswith("\t") | raw_line.startswith("Caused by:") | (lead_ws & raw_line.rlike(STACK_START))
    return (
        stripped.startswith("at ")
        | stack
        | stripped.startswith("Caused by:")
        | exc
        | stripped.contains("common frames omitted")
        | stripped.startswith("MULTIEXCEPTION")
    )


def is_exception_line(stripped: Column, fold: Column | None = None) -> Column:
    """Single identifier ending in Exception/Error (case-insensitive), optional ': text'."""
    f = _fold(stripped, fold)
    hint = f.contains("exception") | f.contains("error")
    return F.when(hint, stripped.rlike(EXCEPTION_LINE)).otherwise(F.lit(False))
