"""Line classification and field extraction (row-local).

``parse_lines`` adds the typed fields of one log line to any DataFrame that
carries the unstripped line in ``raw_line``.  The dispatch order is part of
the semantics: blank, continuation (stack frame / exception, tested on the
unstripped line), access log, structured, generic.  The parse needs no
shuffle and plans no job; a caller with a narrow input repartitions it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions import extract as X

ENTRY_FIELDS = (
    "raw", "entry_type", "timestamp", "level", "logger", "message", "thread_name",
    "component", "request_id", "trace_id", "client_ip", "http_status",
)


_HELPERS = ("_fold", "_exc", "_kind0", "_acc0", "_acc", "_st0", "_st", "_tsv", "_tsp", "_rref",
            "_m1", "_m2", "_m3")
_STAGE_CACHE: dict = {}


def parse_lines(lines: DataFrame, raw_col: str = "raw_line") -> DataFrame:
    """Add parsed columns; keeps the input columns except the unstripped line.

    Continuation rows get NULL level / logger / thread / request / trace here;
    :func:`logfold.operators.context.sequence_entries` fills them from the
    preceding lines.  Blank lines are kept (``entry_type = 'blank'``) because
    they still count for line numbers.

    The work is a chain of projections; an intermediate value used by several
    fields (the stripped line, the access / structured / timestamp group
    arrays, the folded line) is its own column, so Catalyst keeps it
    materialised and each regex runs once per line.
    """
    df = lines
    for stage in _stages(raw_col):
        df = df.select("*", *stage)
    # The unstripped line is only needed for the continuation test; ``raw``
    # (the stripped line) replaces it, so it is not carried into shuffles or
    # staged tables.
    return df.drop(*_HELPERS, raw_col)


def _stages(raw_col: str) -> list[list[Column]]:
    # The expressions only name columns, so they are built once per process
    # (thousands of py4j calls) and reused for every DataFrame.
    from pyspark import SparkContext

    key = (raw_col, id(SparkContext._gateway))
    if key not in _STAGE_CACHE:
        _STAGE_CACHE[key] = _build_stages(raw_col)
    return _STAGE_CACHE[key]


def _build_stages(raw_col: str) -> list[list[Column]]:
    raw_line = F.col(raw_col)
    raw = F.col("raw")
    fold = F.col("_fold")
    blank = raw == ""
    exc = F.col("_exc")
    cont = ~blank & X.is_continuation(raw_line, raw, fold, exc)
    # Literal guards: an access line contains "HTTP/", a structured line
    # starts with "[", so most lines skip those regexes entirely.
    stages: list[list[Column]] = [
        [X.ustrip(raw_line).alias("raw")],
        [X.fold_case(raw).alias("_fold")],
        [X.is_exception_line(raw, fold).alias("_exc")],
        [F.when(blank, F.lit("blank"))
         .when(cont, F.when(exc, F.lit("exception")).otherwise(F.lit("stack_trace")))
         .alias("_kind0")],
        [F.when(F.col("_kind0").isNull() & raw.contains("HTTP/"), X.groups(raw, X.ACCESS, 6)).alias("_acc0")],
        [F.when(X.matched(F.col("_acc0")), F.col("_acc0")).alias("_acc")],
        [F.when(F.col("_kind0").isNull() & F.col("_acc").isNull() & raw.startswith("["),
                X.groups(raw, X.STRUCTURED, 7)).alias("_st0")],
        [F.when(X.matched(F.col("_st0")), F.col("_st0")).alias("_st")],
    ]
    acc = F.col("_acc")
    st = F.col("_st")
    kind = (
        F.when(F.col("_kind0").isNotNull(), F.col("_kind0"))
        .when(acc.isNotNull(), F.lit("access_log"))
        .when(st.isNotNull(), F.lit("structured"))
        .otherwise(F.lit("log"))
    )
    stages.append([kind.alias("entry_type")])
    k = F.col("entry_type")
    is_acc, is_st, is_log = k == "access_log", k == "structured", k == "log"
    is_cont = k.isin("exception", "stack_trace")

    def a(i):
        return X.group(acc, i)

    def s(i):
        return X.group(st, i)

    # Timestamp text of the line (access / structured group, or the leftmost
    # timestamp anywhere in a generic line), then its pieces.
    ts_text = F.when(is_acc, a(2)).when(is_st, s(2)).when(is_log, X.find_timestamp_text(raw))
    stages.append([
        ts_text.alias("_tsv"),
        F.when(is_log, X.request_ref(raw)).alias("_rref"),
        F.when(is_log, X.message_step1(raw)).alias("_m1"),
    ])
    stages.append([
        F.when(F.col("_tsv").isNotNull(), X.timestamp_pieces(F.col("_tsv"))).alias("_tsp"),
        X.message_step2(F.col("_m1")).alias("_m2"),
    ])
    stages.append([X.message_step3(F.col("_m2")).alias("_m3")])

    st_msg = X.ustrip(s(7))
    st_logger = X.nonempty(s(6))
    st_request = X.ustrip(s(5))
    st_trace = X.ustrip(s(4))
    stages.append([
        X.timestamp_from_pieces_array(F.col("_tsp")).alias("timestamp"),
        F.when(is_acc, F.lit("INFO"))
        .when(is_st, X.normalize_level(s(1)))
        .when(is_log, X.extract_level(raw, fold))
        .alias("level"),
        F.when(is_st, F.when(st_msg != "", st_logger))
        .when(is_log, X.extract_logger(raw, fold))
        .alias("logger"),
        F.when(is_acc, F.concat(a(3), F.lit(" "), a(4), F.lit(" status="), a(5)))
        .when(is_st, F.when((st_msg == "") & st_logger.isNotNull(), st_logger).otherwise(st_msg))
        .when(is_log, X.message_step4(F.col("_m3"), X.has_level_word(raw, fold)))
        .when(is_cont, raw)
        .otherwise(F.lit(""))
        .alias("message"),
        F.when(is_st, X.ustrip(s(3)))
        .when(is_log, X.extract_thread(raw, fold))
        .alias("thread_name"),
        F.when(is_acc, F.lit("access_log"))
        .when(is_log, X.extract_component(raw, fold))
        .alias("component"),
        F.when(is_st, F.when((st_request != "") & (st_request != "_default_"), st_request))
        .when(is_log, X.extract_request_id(raw, fold, F.col("_rref")))
        .alias("request_id"),
        F.when(is_st, F.when(st_trace != "_default_", st_trace))
        .when(is_log, X.extract_trace(raw, fold))
        .alias("trace_id"),
        F.when(is_acc, a(1)).alias("client_ip"),
        F.when(is_acc, a(5).try_cast("bigint")).alias("http_status"),
    ])
    return stages
