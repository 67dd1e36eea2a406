"""DuckDB SQL oracles for the driver queries (independent re-statement).

Each query is re-derived directly from the tables with plain SQL: the
corpus lines, the line parse (RE2 regexes; look-arounds become consuming
alternatives), the context carry-forward as one ``last_value(... IGNORE
NULLS)`` window per source over all lines, and the aggregates and top-k as
``GROUP BY`` / ``row_number``.  Column names match :mod:`logfold.plans.queries`.
"""

from __future__ import annotations

import json
import re

from logfold.functions import patterns as P
from logfold.operators.rules import DEFAULT_RULES
from logfold.plans.queries import CUSTOM_RULES, REPLY_SHAPES
from logfold.sources.corpus import EV_LEVELS, EV_MESSAGES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = P.WS
WSC = WS[1:-1]
NW = r"[^\p{L}\p{N}_]"
W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"
LV = "DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL|TRACE"
SEP = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

RX_STACK = rf"^(?:{WS}+at{WS}+|Caused by:|\t)"
RX_EXC = rf"(?i)^[a-z][\p{{L}}\p{{N}}_.$]*(?:Exception|Error)(?::{WS}.*)?$"
RX_ACCESS = (
    rf"^({D}+\.{D}+\.{D}+\.{D}+){WS}+-{WS}+-{WS}+-{WS}+"
    rf"({D}{{2}}/{W}{{3}}/{D}{{4}}:{D}{{2}}:{D}{{2}}:{D}{{2}}){WS}+[+-]{D}{{4}}{WS}+"
    rf'"({W}+){WS}+([^"]+){WS}+HTTP/[^"]+"{WS}+({D}+)'
)
RX_STRUCT = (
    rf"(?i)^\[({LV})\]{WS}*\[({D}{{4}}-{D}{{2}}-{D}{{2}}{WS}+{D}{{2}}:{D}{{2}}:{D}{{2}}(?:,{D}+)?)\]{WS}*"
    rf"\[([^\]]+)\]{WS}*T:(.+?){WS}+-{WS}+R:([^{WSC}\[]*){WS}*(?:\[([^\]]+)\]:?{WS}*)?(.*)$"
)
_HMS = rf"{D}{{2}}:{D}{{2}}:{D}{{2}}"
RX_TS_SEARCH = (
    rf"({D}{{4}}-{D}{{2}}-{D}{{2}}[ T]{_HMS}(?:[.,]{D}+)?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"
    rf"|{D}{{4}}/{D}{{2}}/{D}{{2}}[ T]{_HMS}(?:[.,]{D}+)?"
    rf"|{D}{{2}}-{D}{{2}}-{D}{{4}}[ T]{_HMS}(?:[.,]{D}+)?"
    rf"|{D}{{2}}/{W}{{3}}/{D}{{4}}:{_HMS})"
)
RX_TS_PREFIX = (
    rf"^(?:{D}{{4}}-{D}{{2}}-{D}{{2}}[ T]{_HMS}(?:[.,]{D}+)?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"
    rf"|{D}{{4}}/{D}{{2}}/{D}{{2}}[ T]{_HMS}(?:[.,]{D}+)?"
    rf"|{D}{{2}}-{D}{{2}}-{D}{{4}}[ T]{_HMS}(?:[.,]{D}+)?)(?:{WS}+)?"
)
_T = rf"({D}{{2}}):({D}{{2}}):({D}{{2}})"
RX_ISO = rf"^({D}{{4}})-({D}{{2}})-({D}{{2}})(?:[ T]|{WS}+){_T}(?:[.,]({D}+))?(?:Z|[+-]{D}{{2}}:?{D}{{2}})?$"
RX_SLASH = rf"^({D}{{4}})/({D}{{2}})/({D}{{2}})[ T]{_T}(?:[.,]({D}+))?$"
RX_DAY = rf"^({D}{{2}})-({D}{{2}})-({D}{{4}})[ T]{_T}(?:[.,]({D}+))?$"
RX_ACC_TS = rf"^({D}{{2}})/({W}{{3}})/({D}{{4}}):{_T}$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def rx(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def norm_level(x: str) -> str:
    return f"(CASE WHEN upper({x}) = 'WARN' THEN 'WARNING' ELSE upper({x}) END)"


def iso(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN strftime({x}, '%f') = '000000' "
            f"THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S') || '.' || strftime({x}, '%f') END)")


def _mk_ts(y: str, mo: str, d: str, h: str, mi: str, s: str, fr: str) -> str:
    return (
        f"(CASE WHEN try_cast({y} AS INT) >= 1 AND try_cast({h} AS INT) < 24 AND try_cast({mi} AS INT) < 60 "
        f"AND try_cast({s} AS INT) < 60 AND length({fr}) <= 6 AND {mo} IS NOT NULL "
        f"THEN try_cast({y} || '-' || lpad({mo}, 2, '0') || '-' || {d} || ' ' || {h} || ':' || {mi} || ':' || {s}"
        f" || '.' || rpad({fr}, 6, '0') AS TIMESTAMP) END)"
    )


def ts_from_text(v: str) -> str:
    def g(pat: str, i: int) -> str:
        return f"regexp_extract({v}, {q(pat)}, {i})"

    months = "[" + ", ".join(q(m) for m in P.MONTHS) + "]"
    mon = g(RX_ACC_TS, 2)
    acc_mo = (f"(CASE WHEN NOT contains({mon}, 'T') AND list_position({months}, lower({mon})) > 0 "
              f"THEN CAST(list_position({months}, lower({mon})) AS VARCHAR) END)")
    return (
        f"(CASE WHEN {v} IS NULL THEN NULL "
        f"WHEN regexp_matches({v}, {q(RX_ISO)}) THEN "
        + _mk_ts(*[g(RX_ISO, i) for i in range(1, 8)]) +
        f" WHEN regexp_matches({v}, {q(RX_SLASH)}) THEN "
        + _mk_ts(*[g(RX_SLASH, i) for i in range(1, 8)]) +
        f" WHEN regexp_matches({v}, {q(RX_DAY)}) THEN "
        + _mk_ts(g(RX_DAY, 3), g(RX_DAY, 2), g(RX_DAY, 1), g(RX_DAY, 4), g(RX_DAY, 5), g(RX_DAY, 6), g(RX_DAY, 7)) +
        f" WHEN regexp_matches({v}, {q(RX_ACC_TS)}) THEN "
        + _mk_ts(g(RX_ACC_TS, 3), acc_mo, g(RX_ACC_TS, 1), g(RX_ACC_TS, 4), g(RX_ACC_TS, 5), g(RX_ACC_TS, 6), "''") +
        " END)"
    )


def generic_level(x: str) -> str:
    return norm_level(f"coalesce({rx(x, rf'(?i)^\[({LV})\]')}, {rx(x, rf'(?i)(?:^|{NW})({LV})(?:{NW}|$)')})")


def generic_logger(x: str) -> str:
    skip = ", ".join(q(w) for w in P.LOGGER_SKIP_WORDS)
    cands = f"list_transform(regexp_extract_all({x}, {q(r'\[([^\]]+)\]')}, 1), lambda c: {strip('c')})"
    good = (f"list_filter({cands}, lambda c: c <> '' AND lower(c) NOT IN ({skip}) AND "
            f"(regexp_matches(c, {q(r'^[A-Za-z][A-Za-z0-9_$]*$')}) OR "
            f"(contains(c, '.') AND regexp_matches(c, {q(r'^[A-Za-z0-9_.]+$')}))))")
    word = rx(x, r"(?:\[)?([A-Za-z0-9_.-]+(?:Logger|LOGGER|loger|logger))(?:\])?")
    return f"coalesce({good}[1], {word})"


def generic_thread(x: str) -> str:
    return (f"coalesce({rx(x, rf'(?i)thread(?:{WS}*name)?(?:{WS}*[:=]|{WS}*\[){WS}*([A-Za-z0-9_.-]+)')}, "
            f"{rx(x, r'(?i)\[(Thread[^\]]*)\]')}, {rx(x, r'(?i)\[((?:pool|hystrix|dw)-[^\]]+)\]')})")


def generic_trace(x: str) -> str:
    t = rx(x, rf"(?:^|{NW})T:([^{WSC}-]+)")
    return f"(CASE WHEN {t} <> '_default_' THEN {t} END)"


def generic_component(x: str) -> str:
    return "coalesce(" + ", ".join(rx(x, rf"(?i){tok}[:= ]+([A-Za-z0-9_.-]+)") for tok in P.COMPONENT_TOKENS) + ")"


def generic_request(x: str) -> str:
    ref = strip(f"regexp_extract({x}, {q(rf'(?:^|{NW})R:([^{WSC}\[]+)')}, 1)")
    ref_ok = f"(CASE WHEN {ref} NOT IN ('', '_default_') THEN {ref} END)"
    keys = [
        rx(x, r"(?i)request[_-]?id[:= ]+([A-Za-z0-9-]+)"),
        rx(x, r"(?i)trace[_-]?id[:= ]+([A-Za-z0-9-]+)"),
        rx(x, r"(?i)session[_-]?id[:= ]+([A-Za-z0-9-]+)"),
        rx(x, rf"(?:^|{NW})REQ[-_]?([A-Z0-9]+)(?:{NW}|$)"),
        rx(x, rf"(?:^|{NW})([0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}})(?:{NW}|$)"),
    ]
    return "coalesce(" + ", ".join([ref_ok] + keys) + ")"


def generic_message(x: str) -> str:
    m = strip(f"regexp_replace({x}, {q(RX_TS_PREFIX)}, '')")
    m = f"regexp_replace({m}, {q(rf'(?i)^(?:\[[^\]]+\]{WS}*)+(?:[A-Z_]+{WS}+)?(?:{LV}){WS}*[:\-]?{WS}*')}, '')"
    m = f"regexp_replace({m}, {q(rf'^\[[^\]]+\]{WS}*')}, '')"
    m = f"regexp_replace({m}, {q(rf'(?i)^(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|CRITICAL|FATAL){WS}+\[[^\]]+\]{WS}*')}, '')"
    m = f"regexp_replace({m}, {q(rf'(?i){WS}+(?:{LV})(?:{NW}.*)?$')}, '')"
    return strip(m)


# --- corpora ------------------------------------------------------------------

def _ev_lines_cte(chunk: int | None = None, tail: str = "''") -> str:
    lvl = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EV_LEVELS) + " ELSE 'INFO' END"
    msgs = "[" + ", ".join(q(m) for m in EV_MESSAGES) + "]"
    tc = "replace(t, '.', ',')"
    t19 = "substr(t, 1, 19)"
    u = "CAST(user_id AS VARCHAR)"
    e = "CAST(event_id AS VARCHAR)"
    src = "'svc-' || CAST(user_id % 8 AS VARCHAR)"
    if chunk is not None:
        src += f" || '#' || CAST(event_id // {chunk} AS VARCHAR)"
    raw = f"""CASE event_id % 12
      WHEN 0 THEN {t19} || ' ' || lvl || ' ' || msg
      WHEN 1 THEN replace(t, ' ', 'T') || 'Z ' || lvl || ' ' || msg
      WHEN 2 THEN {tc} || ' ' || lvl || ' [com.example.App' || CAST(user_id % 3 AS VARCHAR) || '] ' || msg
      WHEN 3 THEN replace({t19}, '-', '/') || ' ' || lvl || ' ' || msg
      WHEN 4 THEN strftime(ts, '%d-%m-%Y %H:%M:%S') || ' ' || lvl || ' ' || msg
      WHEN 5 THEN '[' || lvl || '] [' || {tc} || '] [pool-' || CAST(user_id % 4 AS VARCHAR) || '-thread-1] T:tr-' || {e}
                  || ' - R:req-' || {u} || ' [OrderService]: ' || msg
      WHEN 6 THEN '[' || lvl || '] [' || {tc} || '] [dw-' || CAST(user_id % 4 AS VARCHAR)
                  || '] T:_default_ - R:_default_ [JobHandler] ' || msg
      WHEN 7 THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR) || ' - - - ' || strftime(ts, '%d') || '/Jan/'
                  || strftime(ts, '%Y') || ':' || strftime(ts, '%H:%M:%S') || ' +0000 "GET /item/' || {e}
                  || ' HTTP/1.1" ' || (CASE WHEN event_type = 'error' THEN '500' ELSE '200' END) || ' 123'
      WHEN 8 THEN 'com.example.FooException: ' || msg
      WHEN 9 THEN chr(9) || 'at com.example.Foo.bar(Foo.java:' || CAST(event_id % 50 AS VARCHAR) || ')'
      WHEN 10 THEN {t19} || ' ' || lvl || ' request_id=r-' || {u} || ' thread=worker-' || CAST(user_id % 5 AS VARCHAR)
                  || ' Service=Svc' || CAST(user_id % 6 AS VARCHAR) || ' ' || msg
      ELSE '   ' END"""
    return f"""ev_src AS (
    SELECT event_id, user_id, event_type, ts, CAST(ts AS VARCHAR) AS t, {lvl} AS lvl,
           {msgs}[CAST(event_id % 7 AS INTEGER) + 1] AS msg
    FROM events),
  ev_raw AS (SELECT {src} AS source, event_id, ({raw}) || {tail} AS raw_line FROM ev_src),
  lines AS (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY event_id) AS line_number, raw_line FROM ev_raw)"""


def _branch_lines_cte() -> str:
    e, u, t = "CAST(event_id AS VARCHAR)", "CAST(user_id AS VARCHAR)", "substr(CAST(ts AS VARCHAR), 1, 19)"
    return f"""branch_raw AS (SELECT 'gen-' || CAST(user_id % 8 AS VARCHAR) AS source, event_id, CASE event_id % 10
      WHEN 0 THEN {t} || ' FATAL disk lost T:trace' || {e} || ' halted'
      WHEN 1 THEN '[core] CRITICAL: quota of tenant ' || {u} || ' exceeded'
      WHEN 2 THEN {t} || ' ERROR [Thread-' || CAST(user_id % 4 AS VARCHAR) || '] queue full'
      WHEN 3 THEN {t} || ' INFO AuditLogger rotated file ' || {e}
      WHEN 4 THEN {t} || ' WARN R:req' || {u} || ' slow answer'
      WHEN 5 THEN {t} || ' DEBUG job 0f8fad5b-d9cb-469f-a165-70867728' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') || ' ended'
      WHEN 6 THEN 'Caused by: java.io.IOException: stream ' || {u} || ' closed'
      WHEN 7 THEN {t} || ' INFO session-id=s' || {e} || ' thread name: worker' || CAST(user_id % 5 AS VARCHAR) || ' opened'
      WHEN 8 THEN {t} || ' [hystrix-' || CAST(user_id % 3 AS VARCHAR) || '] TRACE trace_id=t' || {u} || ' step'
      ELSE {t} || ' INFO ' || ['Service', 'Component', 'Controller', 'Worker', 'Scheduler', 'DB', 'Cache', 'API'][
        CAST(user_id % 8 AS INTEGER) + 1] || '=unit' || CAST(user_id % 6 AS VARCHAR) || ' REQ-' || {e} || ' served' END AS raw_line FROM events),
  lines AS (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY event_id) AS line_number, raw_line FROM branch_raw)"""


def _doc_lines_cte() -> str:
    return f"""doc_split AS (
    SELECT CAST(doc_id AS VARCHAR) AS source, string_split_regex(coalesce(text, ''), {q(SEP)}) AS parts FROM documents),
  lines AS (
    SELECT source, CAST(UNNEST(range(1, len(parts) + 1)) AS BIGINT) AS line_number, UNNEST(parts) AS raw_line
    FROM doc_split)"""


def _parse_ctes() -> str:
    stack_or_exc = (
        f"starts_with(raw, 'at ') OR regexp_matches(raw_line, {q(RX_STACK)}) OR starts_with(raw, 'Caused by:') "
        f"OR regexp_matches(raw, {q(RX_EXC)}) OR contains(raw, 'common frames omitted') "
        f"OR starts_with(raw, 'MULTIEXCEPTION')"
    )
    acc = [f"regexp_extract(raw, {q(RX_ACCESS)}, {i})" for i in range(1, 6)]
    st = [f"regexp_extract(raw, {q(RX_STRUCT)}, {i})" for i in range(1, 8)]
    known = ", ".join(q(v) for v in P.KNOWN_LEVELS)
    prov = "entry_type IN ('log', 'structured', 'access_log')"
    carry = "OVER (PARTITION BY source ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ctx = []
    for f in ("level", "request_id", "thread_name", "logger", "trace_id"):
        ok = f"{f} IN ({known})" if f == "level" else f"{f} <> ''"
        ctx.append(f"CASE WHEN entry_type IN ('exception', 'stack_trace') THEN "
                   f"last_value(CASE WHEN {prov} AND {ok} THEN {f} END IGNORE NULLS) {carry} ELSE {f} END AS {f}")
    ctx_sql = ",\n      ".join(ctx)
    return f"""p0 AS (SELECT source, line_number, raw_line, {strip('raw_line')} AS raw FROM lines),
  p1 AS (SELECT *, CASE WHEN raw = '' THEN 'blank'
        WHEN {stack_or_exc} THEN (CASE WHEN regexp_matches(raw, {q(RX_EXC)}) THEN 'exception' ELSE 'stack_trace' END)
        WHEN regexp_matches(raw, {q(RX_ACCESS)}) THEN 'access_log'
        WHEN regexp_matches(raw, {q(RX_STRUCT)}) THEN 'structured'
        ELSE 'log' END AS entry_type FROM p0),
  p2 AS (SELECT *,
      CASE WHEN entry_type = 'access_log' THEN {acc[0]} END AS a1,
      CASE WHEN entry_type = 'access_log' THEN {acc[1]} END AS a2,
      CASE WHEN entry_type = 'access_log' THEN {acc[2]} END AS a3,
      CASE WHEN entry_type = 'access_log' THEN {acc[3]} END AS a4,
      CASE WHEN entry_type = 'access_log' THEN {acc[4]} END AS a5,
      {", ".join(f"CASE WHEN entry_type = 'structured' THEN {st[i]} END AS s{i + 1}" for i in range(7))}
    FROM p1),
  p3 AS (SELECT *,
      CASE entry_type WHEN 'access_log' THEN a2 WHEN 'structured' THEN s2
        WHEN 'log' THEN {rx('raw', RX_TS_SEARCH)} END AS tsv
    FROM p2),
  p4 AS (SELECT source, line_number, raw, entry_type,
      {ts_from_text('tsv')} AS ts_val,
      CASE entry_type WHEN 'access_log' THEN 'INFO' WHEN 'structured' THEN {norm_level('s1')}
        WHEN 'log' THEN {generic_level('raw')} END AS level,
      CASE entry_type WHEN 'structured' THEN (CASE WHEN {strip('s7')} <> '' THEN nullif(s6, '') END)
        WHEN 'log' THEN {generic_logger('raw')} END AS logger,
      CASE entry_type WHEN 'access_log' THEN a3 || ' ' || a4 || ' status=' || a5
        WHEN 'structured' THEN (CASE WHEN {strip('s7')} = '' AND nullif(s6, '') IS NOT NULL THEN s6 ELSE {strip('s7')} END)
        WHEN 'log' THEN {generic_message('raw')}
        WHEN 'exception' THEN raw WHEN 'stack_trace' THEN raw ELSE '' END AS message,
      CASE entry_type WHEN 'structured' THEN {strip('s3')} WHEN 'log' THEN {generic_thread('raw')} END AS thread_name,
      CASE entry_type WHEN 'access_log' THEN 'access_log' WHEN 'log' THEN {generic_component('raw')} END AS component,
      CASE entry_type WHEN 'structured' THEN (CASE WHEN {strip('s5')} NOT IN ('', '_default_') THEN {strip('s5')} END)
        WHEN 'log' THEN {generic_request('raw')} END AS request_id,
      CASE entry_type WHEN 'structured' THEN (CASE WHEN {strip('s4')} <> '_default_' THEN {strip('s4')} END)
        WHEN 'log' THEN {generic_trace('raw')} END AS trace_id,
      CASE WHEN entry_type = 'access_log' THEN a1 END AS client_ip,
      CASE WHEN entry_type = 'access_log' THEN try_cast(a5 AS BIGINT) END AS http_status
    FROM p3),
  p5 AS (SELECT source, line_number, raw, entry_type, ts_val, message, component, client_ip, http_status,
      {ctx_sql}
    FROM p4),
  entries AS (SELECT * FROM p5 WHERE entry_type <> 'blank')"""


def with_ev(body: str) -> str:
    return f"WITH {_ev_lines_cte()},\n  {_parse_ctes()}\n{body}"


def with_ev_files(body: str) -> str:
    from logfold.sources.corpus import EV_FILE_CHUNK

    return f"WITH {_ev_lines_cte(EV_FILE_CHUNK)},\n  {_parse_ctes()}\n{body}"


def file_reports_sql() -> str:
    """Audit and report of the odd files; the bytes that are no UTF-8 are read as U+FFFD (3 bytes for 1)."""
    from logfold.sources.corpus import ODD_BYTES_EVERY

    odd = f"event_id % {ODD_BYTES_EVERY} = 0"
    tail = f"CASE WHEN {odd} THEN ' ' || chr(65533) || 'x' || chr(65533) || '(' ELSE '' END"
    return f"""WITH {_ev_lines_cte(tail=tail)},
  {_parse_ctes()}{_report_ctes()},
  sizes AS (SELECT source, CAST(sum(octet_length(encode(raw_line)) + 1 - CASE WHEN {odd} THEN 4 ELSE 0 END) AS BIGINT) AS bytes
    FROM ev_raw GROUP BY source),
  judged AS (SELECT *, bytes < max(bytes) OVER () AS kept FROM sizes)
SELECT j.source AS name, CASE WHEN kept THEN 'admitted' ELSE 'rejected' END AS status,
  CASE WHEN kept THEN '' ELSE 'exceeds the size limit' END AS reason, CASE WHEN kept THEN bytes ELSE 0 END AS bytes,
  CASE WHEN kept THEN executive_summary[1] END AS executive_summary,
  CASE WHEN kept THEN array_to_string(interesting_log_snippets, '|') END AS snippets,
  CASE WHEN kept THEN array_to_string(recommendations, '|') END AS recommendations,
  CASE WHEN kept THEN CAST(total_lines AS VARCHAR) END AS total_lines
FROM judged j JOIN r2 ON r2.source = j.source
UNION ALL SELECT 'empty', 'admitted', '', 0, {q(P.SUMMARY_EMPTY)}, '', {q(P.REC_DEFAULT)}, '0'
UNION ALL SELECT 'json', 'rejected', {q("unsupported file type '.json'")}, 0, NULL, NULL, NULL, NULL
UNION ALL SELECT 'missing', 'missing', 'file does not exist', 0, NULL, NULL, NULL, NULL"""


def with_branches(body: str) -> str:
    return f"WITH {_branch_lines_cte()},\n  {_parse_ctes()}\n{body}"


def with_doc(body: str) -> str:
    return f"WITH {_doc_lines_cte()},\n  {_parse_ctes()}\n{body}"


# --- query bodies ---------------------------------------------------------------

ERR = "('ERROR', 'CRITICAL', 'FATAL')"

FLAT_ENTRIES = f"""SELECT source, line_number, raw, entry_type, {iso('ts_val')} AS ts, level, logger, message,
  thread_name, component, request_id, trace_id, client_ip, CAST(http_status AS VARCHAR) AS http_status FROM entries"""

OVERVIEW = f"""SELECT source, count(*) AS total_lines,
  CASE WHEN min(ts_val) IS NULL THEN NULL ELSE {iso('min(ts_val)')} || ' -> ' || {iso('max(ts_val)')} END AS time_range,
  coalesce(string_agg(DISTINCT nullif(level, ''), ', ' ORDER BY nullif(level, '')), '') AS levels,
  count(*) FILTER (WHERE level IN {ERR}) AS error_total,
  count(*) FILTER (WHERE level = 'WARNING') AS warning_total
FROM entries GROUP BY source"""

FIRST_VALUES = """SELECT source, dimension, value,
  row_number() OVER (PARTITION BY source, dimension ORDER BY value) AS rank
FROM (SELECT DISTINCT source, dimension, value FROM (
    SELECT source, 'component' AS dimension, nullif(component, '') AS value FROM entries
    UNION ALL SELECT source, 'request_id', nullif(request_id, '') FROM entries
    UNION ALL SELECT source, 'thread_name', nullif(thread_name, '') FROM entries) WHERE value IS NOT NULL)
QUALIFY rank <= 10"""

STATS_LEVELS = """SELECT source, level, count(*) AS n, min(line_number) AS first_line
FROM entries WHERE nullif(level, '') IS NOT NULL GROUP BY source, level"""

STATS_TOP10 = """SELECT source, dimension, value, n, first_line,
  row_number() OVER (PARTITION BY source, dimension ORDER BY n DESC, first_line) AS rank
FROM (SELECT source, dimension, value, count(*) AS n, min(line_number) AS first_line FROM (
    SELECT source, line_number, 'components' AS dimension, nullif(component, '') AS value FROM entries
    UNION ALL SELECT source, line_number, 'request_ids', nullif(request_id, '') FROM entries
    UNION ALL SELECT source, line_number, 'thread_names', nullif(thread_name, '') FROM entries)
  WHERE value IS NOT NULL GROUP BY source, dimension, value)
QUALIFY rank <= 10"""


def groups_sql(pred: str, unknown: str) -> str:
    return f"""SELECT source, row_number() OVER (PARTITION BY source ORDER BY occurrence_count DESC, first_line) AS rank,
  substr(group_key, 1, 120) AS label, occurrence_count, {iso('first_ts')} AS first_occurrence,
  {iso('last_ts')} AS last_occurrence, first_line
FROM (SELECT source, CASE WHEN message <> '' THEN message ELSE {q(unknown)} END AS group_key,
    count(*) AS occurrence_count, min(ts_val) AS first_ts, max(ts_val) AS last_ts, min(line_number) AS first_line
  FROM entries WHERE {pred} GROUP BY ALL)"""


TIMELINE = f"""SELECT source, rank, line_number, {iso('ts_val')} AS timestamp, substr(message, 1, 200) AS message, level
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY notable DESC, line_number) AS rank,
    max(notable) OVER (PARTITION BY source) AS best
  FROM (SELECT *, CASE WHEN level IN ('ERROR', 'WARNING', 'CRITICAL', 'FATAL') THEN 1 ELSE 0 END AS notable FROM entries))
WHERE rank <= 12 AND notable = best"""


def _kw(words) -> str:
    return "(" + " OR ".join(f"contains(lower(message), {q(w)})" for w in words) + ")"


def _signal_lists_cte(rules=DEFAULT_RULES) -> str:
    def sentences(kind: str) -> str:
        found = [(s, [w.lower() for w in words]) for k, _, s, words in sorted(rules, key=lambda r: (r[1], r[2])) if k == kind]
        return ", ".join(f"CASE WHEN bool_or({_kw(words)}) THEN {q(s)} END" for s, words in found)

    kept = "list_filter([{}], lambda x: x IS NOT NULL)".format
    return f"""sig AS (
    SELECT source, count(*) AS total_lines,
      count(*) FILTER (WHERE level = 'ERROR') AS error_events,
      count(*) FILTER (WHERE level = 'WARNING') AS warning_events,
      count(*) FILTER (WHERE level IN {ERR}) AS error_total,
      count(*) FILTER (WHERE level = 'WARNING') AS warning_total,
      min(ts_val) AS min_ts, max(ts_val) AS max_ts,
      coalesce(string_agg(DISTINCT nullif(level, ''), ', ' ORDER BY nullif(level, '')), '') AS levels_txt,
      {kept(sentences('analyzer_pattern'))} AS analyzer_patterns,
      {kept(sentences('analyzer_anomaly'))} AS analyzer_anomalies,
      {kept(sentences('pattern'))} AS detector_patterns,
      {kept(sentences('anomaly'))} AS detector_anomalies
    FROM entries GROUP BY source),
  sig2 AS (SELECT *,
      list_concat(list_concat(list_filter([
        CASE WHEN error_events > 0 THEN CAST(error_events AS VARCHAR) || ' error events detected.' END,
        CASE WHEN warning_events > 0 THEN CAST(warning_events AS VARCHAR) || ' warning events detected.' END],
        lambda x: x IS NOT NULL), analyzer_patterns)[1:8], detector_patterns) AS pattern_detection,
      list_concat(list_concat(list_filter([
        CASE WHEN error_events > 0 AND warning_events > 0 THEN {q(P.SENT_WARN_WITH_ERRORS)} END],
        lambda x: x IS NOT NULL), analyzer_anomalies), detector_anomalies) AS anomalies
    FROM sig)"""


def signals_sql(rules=DEFAULT_RULES) -> str:
    return f""", {_signal_lists_cte(rules)}
SELECT source, error_events, warning_events, array_to_string(pattern_detection, ' | ') AS pattern_detection,
  array_to_string(anomalies, ' | ') AS anomalies FROM sig2"""


SNIPPET_CTES = f""", eg AS ({groups_sql(f"level IN {ERR}", P.UNKNOWN_ERROR)}),
  top AS (SELECT source, rank AS g_rank, substr(label, 1, 40) AS prefix FROM eg WHERE rank <= 3),
  matched AS (
    SELECT t.source, t.g_rank, arg_min(e.raw, e.line_number) AS raw
    FROM top t JOIN entries e ON e.source = t.source AND e.level IN {ERR} AND starts_with(e.message, t.prefix)
    GROUP BY t.source, t.g_rank),
  err_raw AS (SELECT source, raw, min(line_number) AS first_line FROM entries WHERE level IN {ERR} GROUP BY source, raw),
  rest AS (SELECT * FROM err_raw r WHERE NOT EXISTS (
    SELECT 1 FROM matched m WHERE m.source = r.source AND m.raw = r.raw)),
  snip AS (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY part, pos) AS rank, raw FROM (
      SELECT source, 0 AS part, g_rank AS pos, raw FROM matched
      UNION ALL SELECT source, 1 AS part, first_line AS pos, raw FROM rest)
    QUALIFY rank <= 5)"""

SNIPPETS = SNIPPET_CTES + "\nSELECT source, rank, raw FROM snip"

_FMT = f"'[' || coalesce({iso('ts_val')}, 'unknown') || '] ' || coalesce(nullif(level, ''), 'UNKNOWN') || ' ' || raw"
def evidence_ctes(rules=DEFAULT_RULES) -> str:
    lifecycle = [w.lower() for kind, _, _, words in rules if kind == "lifecycle" for w in words]
    return f""", base AS (SELECT source, line_number, level, message, {_FMT} AS line FROM entries),
  sect AS (
    SELECT source, 'error_lines' AS section, row_number() OVER (PARTITION BY source ORDER BY line_number) AS rank,
      line_number, line FROM base WHERE level IN {ERR} QUALIFY rank <= 150
    UNION ALL
    SELECT source, 'warning_lines', row_number() OVER (PARTITION BY source ORDER BY line_number) AS rank,
      line_number, line FROM base WHERE level = 'WARNING' QUALIFY rank <= 150
    UNION ALL
    SELECT source, 'lifecycle_lines', row_number() OVER (PARTITION BY source ORDER BY line_number) AS rank,
      line_number, line FROM base WHERE {_kw(lifecycle)} QUALIFY rank <= 150),
  prio AS (SELECT source, line, min(line_number) AS first_line FROM sect GROUP BY source, line),
  head AS (SELECT source, line_number, line, 1 AS part, line_number AS pos,
      row_number() OVER (PARTITION BY source ORDER BY line_number) AS r FROM base QUALIFY r <= 50),
  tail AS (SELECT source, line_number, line, 2 AS part, line_number AS pos,
      row_number() OVER (PARTITION BY source ORDER BY line_number DESC) AS r FROM base QUALIFY r <= 50),
  ht AS (SELECT * FROM (SELECT source, line_number, line, part, pos FROM head
      UNION ALL SELECT source, line_number, line, part, pos FROM tail) h
    WHERE NOT EXISTS (SELECT 1 FROM prio p WHERE p.source = h.source AND p.line = h.line)),
  sample AS (
    SELECT source, 'sample_lines' AS section, row_number() OVER (PARTITION BY source ORDER BY part, pos) AS rank,
      line_number, line FROM (
        SELECT source, first_line AS line_number, line, 0 AS part, first_line AS pos FROM prio
        UNION ALL SELECT source, line_number, line, part, pos FROM ht)
    QUALIFY rank <= 500)"""


EVIDENCE_CTES = evidence_ctes()
EVIDENCE_ROWS = """
SELECT source, section, rank, line_number, line FROM sect
UNION ALL SELECT source, section, rank, line_number, line FROM sample"""

EVIDENCE = EVIDENCE_CTES + EVIDENCE_ROWS

def _report_ctes() -> str:
    """CTEs up to ``r2``: the text sections of the report, one row per source."""
    fact_rules = ", ".join(
        f"CASE WHEN len(list_filter(facts, lambda f: contains(lower(f), {q(w)}))) > 0 THEN {q(s)} END"
        for w, s in P.CAUSE_RULES)
    rec_rules = ", ".join(
        f"CASE WHEN len(list_filter(detector_patterns, lambda f: contains(lower(f), {q(w)}))) > 0 THEN {q(s)} END"
        for w, s in P.REC_PATTERN_RULES)
    return f"""{SNIPPET_CTES},
  {_signal_lists_cte()},
  top_facts AS (
    SELECT source, list(label || ' occurred ' || CAST(occurrence_count AS VARCHAR) || ' time(s) between '
        || coalesce(first_occurrence, 'unknown') || ' and ' || coalesce(last_occurrence, 'unknown') || '.'
        ORDER BY rank) AS facts, min(label) FILTER (WHERE rank = 1) AS primary_label
    FROM eg WHERE rank <= 3 GROUP BY source),
  snips AS (SELECT source, list(raw ORDER BY rank) AS snippets FROM snip GROUP BY source),
  r0 AS (
    SELECT s.*, list_concat(coalesce(t.facts, []::VARCHAR[]), s.detector_patterns[1:5], s.detector_anomalies[1:5]) AS facts,
      t.primary_label, coalesce(n.snippets, []::VARCHAR[]) AS snippets
    FROM sig2 s LEFT JOIN top_facts t USING (source) LEFT JOIN snips n USING (source)),
  r1 AS (SELECT *,
      list_filter([{fact_rules}], lambda x: x IS NOT NULL) AS causes0,
      list_filter([
        CASE WHEN error_total > 0 THEN {q(P.REC_ERRORS)} END,
        CASE WHEN warning_total > 0 THEN {q(P.REC_WARNINGS)} END,
        {rec_rules}], lambda x: x IS NOT NULL) AS recs0
    FROM r0),
  r2 AS (SELECT source, total_lines, levels_txt,
      CASE WHEN min_ts IS NOT NULL THEN {iso('min_ts')} || ' -> ' || {iso('max_ts')} END AS time_range,
      [CASE WHEN total_lines = 0 THEN {q(P.SUMMARY_EMPTY)} ELSE concat_ws(' ',
        'The log contains ' || CAST(total_lines AS VARCHAR) || ' parsed line(s) with levels '
          || (CASE WHEN levels_txt = '' THEN 'unknown' ELSE levels_txt END) || '.',
        CASE WHEN min_ts IS NOT NULL THEN 'Time range: ' || {iso('min_ts')} || ' -> ' || {iso('max_ts')} || '.' END,
        'Execution appears ' || (CASE WHEN error_total > 0 AND warning_total > 0 THEN 'degraded'
            WHEN error_total > 0 THEN 'failed' ELSE 'healthy' END)
          || ' with ' || CAST(error_total AS VARCHAR) || ' error occurrence(s) and '
          || CAST(warning_total AS VARCHAR) || ' warning occurrence(s).',
        CASE WHEN primary_label IS NOT NULL THEN 'Primary issue: ' || substr(primary_label, 1, 160) || '.' END) END]
        AS executive_summary,
      pattern_detection, anomalies, facts AS observed_facts,
      CASE WHEN len(causes0) = 0 AND error_total > 0 THEN [{q(P.CAUSE_DEFAULT)}] ELSE causes0 END AS possible_causes,
      CASE WHEN len(facts) = 0 THEN [{q(P.ASSUMPTION_NO_FACTS)}] ELSE []::VARCHAR[] END AS assumptions,
      (CASE WHEN len(recs0) = 0 THEN [{q(P.REC_DEFAULT)}] ELSE recs0 END)[1:6] AS recommendations,
      snippets AS interesting_log_snippets
    FROM r1)"""


def report_sections_sql() -> str:
    return f"""{_report_ctes()},
  longf AS (
    SELECT source, 'executive_summary' AS section, executive_summary AS items FROM r2
    UNION ALL SELECT source, 'pattern_detection', pattern_detection FROM r2
    UNION ALL SELECT source, 'anomalies', anomalies FROM r2
    UNION ALL SELECT source, 'observed_facts', observed_facts FROM r2
    UNION ALL SELECT source, 'possible_causes', possible_causes FROM r2
    UNION ALL SELECT source, 'assumptions', assumptions FROM r2
    UNION ALL SELECT source, 'recommendations', recommendations FROM r2
    UNION ALL SELECT source, 'interesting_log_snippets', interesting_log_snippets FROM r2)
SELECT source, section, CAST(UNNEST(range(1, len(items) + 1)) AS BIGINT) AS rank, UNNEST(items) AS text
FROM longf"""


def _group_list(table: str, name: str, explanation: str) -> str:
    return f"""SELECT source, list({{'{name}': label, 'occurrence_count': occurrence_count,
      'first_occurrence': first_occurrence, 'last_occurrence': last_occurrence,
      'short_explanation': {q(explanation)}}} ORDER BY rank) AS items FROM {table} GROUP BY source"""


def _report_tables() -> str:
    """CTEs of the whole report: ``r2`` and the lists of the other sections."""
    return f"""{_report_ctes()},
  wg AS ({groups_sql("level = 'WARNING'", P.UNKNOWN_WARNING)}),
  err_list AS ({_group_list('eg', 'error_type', 'Repeated error condition observed in logs.')}),
  warn_list AS ({_group_list('wg', 'warning_type', 'Repeated warning condition observed in logs.')}),
  fv AS ({FIRST_VALUES}),
  fvl AS (SELECT source, list(value ORDER BY rank) FILTER (WHERE dimension = 'component') AS comps,
      list(value ORDER BY rank) FILTER (WHERE dimension = 'request_id') AS reqs,
      list(value ORDER BY rank) FILTER (WHERE dimension = 'thread_name') AS thr FROM fv GROUP BY source),
  tl AS (SELECT source, list({{'timestamp': "timestamp", 'message': message, 'source': level}} ORDER BY rank) AS items
    FROM ({TIMELINE}) GROUP BY source)"""


_REPORT_JOIN = """FROM r2 r LEFT JOIN fvl f USING (source) LEFT JOIN tl t USING (source) LEFT JOIN err_list e USING (source)
LEFT JOIN warn_list w USING (source)"""
_LEVEL_LIST = "CASE WHEN levels_txt = '' THEN [] ELSE string_split(levels_txt, ', ') END"


def report_json_sql() -> str:
    """The nested report of each source as compact JSON text, all ten sections."""
    return f"""{_report_tables()}
SELECT r.source, CAST(to_json({{'source': r.source, 'executive_summary': r.executive_summary[1],
    'log_overview': {{'time_range': r.time_range, 'total_lines_processed': r.total_lines,
      'log_levels_observed': {_LEVEL_LIST},
      'major_components': coalesce(f.comps, []), 'request_identifiers': coalesce(f.reqs, []),
      'thread_names': coalesce(f.thr, [])}},
    'timeline': coalesce(t.items, []), 'error_analysis': coalesce(e.items, []), 'warning_analysis': coalesce(w.items, []),
    'pattern_detection': r.pattern_detection, 'anomalies': r.anomalies,
    'likely_root_cause': {{'observed_facts': r.observed_facts, 'possible_causes': r.possible_causes,
      'assumptions': r.assumptions}},
    'recommendations': r.recommendations, 'interesting_log_snippets': r.interesting_log_snippets,
    'analysis_source': 'static_fallback'}}) AS VARCHAR) AS json
{_REPORT_JOIN}"""


# JSON text with a two-space layout.  The EV lines are ASCII; the escapes they need are the quote, the backslash and tabs.

def _js(x: str) -> str:
    escaped = f"replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(9), chr(92) || 't')"
    return f"coalesce('\"' || {escaped} || '\"', 'null')"


def _nl(depth: int) -> str:
    return "chr(10) || '" + "  " * depth + "'"


def _sql_block(items: str, marks: str, depth: int) -> str:
    """Item texts (a list expression) between brackets, one a line."""
    return (f"CASE WHEN len(coalesce({items}, [])) = 0 THEN '{marks}' ELSE '{marks[0]}' || {_nl(depth + 1)} || "
            f"array_to_string({items}, ',' || {_nl(depth + 1)}) || {_nl(depth)} || '{marks[1]}' END")


def _sql_list(items: str, depth: int) -> str:
    return _sql_block(f"list_transform({items}, lambda x: {_js('x')})", "[]", depth)


def _sql_object(fields: dict[str, str], depth: int) -> str:
    body = f" || ',' || {_nl(depth + 1)} || ".join(f"'\"{k}\": ' || {v}" for k, v in fields.items())
    return f"'{{' || {_nl(depth + 1)} || {body} || {_nl(depth)} || '}}'"


def _sql_map(items: str, depth: int) -> str:
    entry = f"{_js('x.value')} || ': ' || CAST(x.n AS VARCHAR)"
    return _sql_block(f"list_transform({items}, lambda x: {entry})", "{}", depth)


def _num(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _bundle_ctes() -> str:
    """CTE ``bundle``: the evidence of each source with its maps and lists."""
    def section(name: str) -> str:
        return f"list(line ORDER BY rank) FILTER (WHERE section = '{name}') AS {name}"

    def dimension(name: str) -> str:
        return f"list({{'value': value, 'n': n}} ORDER BY rank) FILTER (WHERE dimension = '{name}') AS {name}"

    return EVIDENCE_CTES + f""",
  tot AS (SELECT source, count(*) AS total_lines,
      CASE WHEN min(ts_val) IS NULL THEN NULL ELSE {iso('min(ts_val)')} || ' -> ' || {iso('max(ts_val)')} END AS time_range
    FROM entries GROUP BY source),
  lists AS (SELECT source, {section('sample_lines')}, {section('error_lines')}, {section('warning_lines')}, {section('lifecycle_lines')}
    FROM (SELECT * FROM sect UNION ALL SELECT * FROM sample) GROUP BY source),
  lv AS (SELECT source, list({{'value': level, 'n': n}} ORDER BY first_line) AS levels FROM ({STATS_LEVELS}) GROUP BY source),
  tops AS (SELECT source, {dimension('components')}, {dimension('request_ids')}, {dimension('thread_names')}
    FROM ({STATS_TOP10}) GROUP BY source),
  bundle AS (SELECT * FROM tot LEFT JOIN lists USING (source) LEFT JOIN lv USING (source) LEFT JOIN tops USING (source))"""


def evidence_bundle_sql() -> str:
    maps = " UNION ALL ".join(
        f"SELECT source, '{d}' AS part, generate_subscripts({d}, 1) AS rank, unnest({d}).value AS text, unnest({d}).n AS n FROM bundle"
        for d in ("levels", "components", "request_ids", "thread_names"))
    lines = " UNION ALL ".join(
        f"SELECT source, '{c}', generate_subscripts({c}, 1), unnest({c}), 0 FROM bundle"
        for c in ("sample_lines", "error_lines", "warning_lines", "lifecycle_lines"))
    return f"""{_bundle_ctes()}
{maps} UNION ALL {lines}
UNION ALL SELECT source, 'total_lines', 1, NULL, total_lines FROM bundle
UNION ALL SELECT source, 'statistics_total', 1, NULL, total_lines FROM bundle
UNION ALL SELECT source, 'time_range', 1, time_range, 0 FROM bundle"""


def prompt_sql() -> str:
    head = (P.ANALYSIS_PROMPT_HEAD + P.ANALYSIS_RULES + "\n\nJSON schema:\n" + json.dumps(P.REPORT_SCHEMA_TEXT, indent=2)
            + "\n\nEvidence bundle:\n")
    statistics = {"total_lines": _num("total_lines")} | {
        d: _sql_map(d, 2) for d in ("levels", "components", "request_ids", "thread_names")}
    evidence = {"total_lines": _num("total_lines"), "time_range": _js("time_range"), "statistics": _sql_object(statistics, 1)} | {
        c: _sql_list(c, 1) for c in ("sample_lines", "error_lines", "warning_lines", "lifecycle_lines")}
    return f"{_bundle_ctes()}\nSELECT source, {q(head)} || {_sql_object(evidence, 0)} AS prompt FROM bundle"


def refinement_sql() -> str:
    def groups(items: str, name: str) -> str:
        fields = {name: _js(f"x.{name}"), "occurrence_count": _num("x.occurrence_count")} | {
            k: _js(f"x.{k}") for k in ("first_occurrence", "last_occurrence", "short_explanation")}
        return _sql_block(f"list_transform({items}, lambda x: {_sql_object(fields, 2)})", "[]", 1)

    event = {k: _js(f'x."{k}"') for k in ("timestamp", "message", "source")}
    overview = {"time_range": _js("r.time_range"), "total_lines_processed": _num("r.total_lines"),
                "log_levels_observed": _sql_list(_LEVEL_LIST, 2), "major_components": _sql_list("f.comps", 2),
                "request_identifiers": _sql_list("f.reqs", 2), "thread_names": _sql_list("f.thr", 2)}
    report = {
        "executive_summary": _js("r.executive_summary[1]"), "log_overview": _sql_object(overview, 1),
        "timeline": _sql_block(f"list_transform(t.items, lambda x: {_sql_object(event, 2)})", "[]", 1),
        "error_analysis": groups("e.items", "error_type"), "warning_analysis": groups("w.items", "warning_type"),
        "pattern_detection": _sql_list("r.pattern_detection", 1), "anomalies": _sql_list("r.anomalies", 1),
        "likely_root_cause": _sql_object({k: _sql_list(f"r.{k}", 2) for k in ("observed_facts", "possible_causes", "assumptions")}, 1),
        "recommendations": _sql_list("r.recommendations", 1), "interesting_log_snippets": _sql_list("r.interesting_log_snippets", 1),
    }
    return f"""{_report_tables()}
SELECT r.source, {q(P.REFINEMENT_PROMPT_HEAD + 'Report:' + chr(10))} || {_sql_object(report, 0)} AS prompt
{_REPORT_JOIN}"""


def model_report_sql() -> str:
    """What the stand-in model answers (by the line count) and what becomes of it."""
    summary = P.SYSTEM_PROMPT.split(".")[0]
    return f"""{_report_tables()},
  asked AS (SELECT source, count(*) AS n,
      least(count(*) FILTER (WHERE level IN {ERR}), 150) AS errors FROM entries GROUP BY source),
  lvs AS (SELECT source, list({{'level': level, 'n': n}} ORDER BY first_line) AS levels FROM ({STATS_LEVELS}) GROUP BY source),
  answer AS (SELECT *, CASE n % 5 WHEN 2 THEN 'RuntimeError: no capacity for ' || n || ' lines'
      WHEN 3 THEN 'LLM returned invalid JSON: I cannot read ' || n || ' lines.'
      WHEN 4 THEN 'Report validation failed: log_overview: field required' END AS llm_error
    FROM asked LEFT JOIN lvs USING (source))
SELECT r.source, CASE WHEN llm_error IS NULL THEN 'llm' ELSE 'static_fallback' END AS analysis_source, llm_error,
  CASE WHEN llm_error IS NULL THEN {q(summary)} || ': ' || n || ' lines, ' || errors || ' error lines'
    ELSE r.executive_summary[1] END AS executive_summary,
  r.total_lines, r.time_range,
  CASE WHEN llm_error IS NULL THEN levels[1].level ELSE e.items[1].error_type END AS first_group,
  CAST(CASE WHEN llm_error IS NULL THEN levels[1].n ELSE e.items[1].occurrence_count END AS VARCHAR) AS first_count,
  CAST(CASE WHEN llm_error IS NULL THEN len(levels) ELSE coalesce(len(e.items), 0) END AS BIGINT) AS n_groups
{_REPORT_JOIN} JOIN answer a ON a.source = r.source"""


ADMISSION = f"""SELECT source AS folder, 'admitted' AS status, '' AS reason,
  CAST(sum(octet_length(encode(raw_line)) + 1) AS BIGINT) AS bytes
FROM lines GROUP BY source
UNION ALL SELECT 'json', 'rejected', {q("unsupported file type '.json'")}, 0"""


_FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"


def _reply_sql() -> str:
    """The reply of a labelled document, by shape."""
    fixed = {"SUMMARY": "summ", "OVERVIEW": "ov", "GROUP": "grp", "DOC": "d", "N": "n"}

    def text(shape: str) -> str:
        parts = [x for x in re.split(r"\b(SUMMARY|OVERVIEW|GROUP|DOC|N)\b", shape) if x]
        return " || ".join(fixed.get(x) or q(x) for x in parts)

    return f"CASE doc_id % {len(REPLY_SHAPES)} " + " ".join(f"WHEN {i} THEN {text(x)}" for i, x in enumerate(REPLY_SHAPES)) + " END"


def _bad(path: str, bad: str, what: str, required: bool = False, at: str | None = None) -> str:
    """CASE: the problem of one field of ``body``; ``at`` is the path to show."""
    shown = at or q(path.removeprefix("$."))
    missing = f"WHEN json_type({path!r}) IS NULL THEN {shown} || ': field required' " if required else ""
    return f"CASE {missing}WHEN {bad} THEN {shown} || ': input should be a valid {what}' END".replace("json_type('", "json_type(body, '")


def _not(path: str, *kinds: str) -> str:
    return f"json_type(body, '{path}') NOT IN ({', '.join(map(q, kinds))})"


def _each(path: str, problem: str) -> str:
    """The first problem among the items ``x`` (index ``i``) of a list."""
    return (f"list_filter(list_transform(json_extract(body, '{path}[*]'), lambda x, i: {problem}), lambda p: p IS NOT NULL)[1]")


def _whole_sql(v: str) -> str:
    s = f"json_extract_string({v}, '$')"
    return (f"(CASE json_type({v}) WHEN 'UBIGINT' THEN true WHEN 'BIGINT' THEN true WHEN 'BOOLEAN' THEN true "
            f"WHEN 'DOUBLE' THEN CAST({s} AS DOUBLE) = floor(CAST({s} AS DOUBLE)) "
            f"WHEN 'VARCHAR' THEN regexp_full_match(trim({s}), '[+-]?[0-9]+(\\.0+)?') ELSE false END)")


def _count_sql(v: str) -> str:
    s = f"json_extract_string({v}, '$')"
    return f"CASE {s} WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE CAST(CAST(CAST({s} AS DOUBLE) AS BIGINT) AS VARCHAR) END"


def model_choice_sql() -> str:
    item = "CAST(i - 1 AS VARCHAR)"
    text = "input should be a valid string"
    event = (f"CASE WHEN json_type(x) <> 'OBJECT' THEN 'timeline.' || {item} || ': input should be a valid dictionary' "
             f"WHEN json_type(x, '$.message') IS NULL THEN 'timeline.' || {item} || '.message: field required' END")
    error = (f"CASE WHEN json_type(x) <> 'OBJECT' THEN 'error_analysis.' || {item} || ': input should be a valid dictionary' "
             f"WHEN NOT {_whole_sql("json_extract(x, '$.occurrence_count')")} "
             f"THEN 'error_analysis.' || {item} || '.occurrence_count: input should be a valid integer' END")
    warning = (f"CASE WHEN json_type(x, '$.first_occurrence') NOT IN ('VARCHAR', 'NULL') "
               f"THEN 'warning_analysis.' || {item} || '.first_occurrence: {text}' END")
    words = f"CASE WHEN json_type(x) <> 'VARCHAR' THEN 'pattern_detection.' || {item} || ': {text}' END"
    total = "json_extract(body, '$.log_overview.total_lines_processed')"
    problems = [
        _bad("$.executive_summary", _not("$.executive_summary", "VARCHAR"), "string", True),
        _bad("$.log_overview", _not("$.log_overview", "OBJECT"), "dictionary", True),
        f"CASE WHEN {total} IS NOT NULL AND NOT {_whole_sql(total)} "
        "THEN 'log_overview.total_lines_processed: input should be a valid integer' END",
        _bad("$.timeline", _not("$.timeline", "ARRAY"), "list"), _each("$.timeline", event),
        _each("$.error_analysis", error), _each("$.warning_analysis", warning), _each("$.pattern_detection", words),
        _bad("$.likely_root_cause", _not("$.likely_root_cause", "OBJECT"), "dictionary"),
        _bad("$.likely_root_cause.observed_facts", _not("$.likely_root_cause.observed_facts", "ARRAY"), "list"),
    ]
    return f"""WITH parts AS (
    SELECT doc_id, toxic, CAST(doc_id AS VARCHAR) AS d,
      '"executive_summary": "Doc ' || CAST(doc_id AS VARCHAR) || ' quality ' || CAST(quality AS VARCHAR) || '"' AS summ,
      '"log_overview": {{"total_lines_processed": ' || CAST(doc_id % 100 AS VARCHAR)
        || ', "log_levels_observed": ["INFO"]}}' AS ov,
      '"error_analysis": [{{"error_type": "E' || CAST(doc_id % 7 AS VARCHAR) || '", "occurrence_count": ' AS grp,
      CAST(doc_id % 100 AS VARCHAR) AS n
    FROM labels),
  resp AS (
    SELECT d AS source, CASE WHEN toxic = 1 AND doc_id % 5 = 0 THEN NULL ELSE {_reply_sql()} END AS response,
      CASE WHEN toxic = 1 AND doc_id % 5 = 0 THEN 'RuntimeError: upstream unavailable' END AS error
    FROM parts),
  c AS (SELECT *, CASE WHEN regexp_matches(trim(response), {q(_FENCE)})
      THEN trim(regexp_extract(trim(response), {q(_FENCE)}, 1)) ELSE trim(response) END AS text FROM resp),
  j AS (SELECT *, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN CAST(text AS JSON) END AS body FROM c),
  v AS (SELECT *, CASE WHEN error IS NOT NULL THEN error
      WHEN NOT json_valid(text) THEN 'LLM returned invalid JSON'
      WHEN body IS NULL THEN 'LLM response must be a JSON object.'
      ELSE 'Report validation failed: ' || coalesce({", ".join(problems)}) END AS reason FROM j)
SELECT source, CASE WHEN reason IS NULL THEN 'llm' ELSE 'static_fallback' END AS analysis_source, reason,
  CASE WHEN reason IS NULL THEN json_extract_string(body, '$.executive_summary') END AS executive_summary,
  CASE WHEN reason IS NULL THEN {_count_sql("json_extract(body, '$.log_overview.total_lines_processed')")} END AS total_lines,
  CASE WHEN reason IS NULL THEN {_count_sql("json_extract(body, '$.error_analysis[0].occurrence_count')")} END AS first_count,
  CASE WHEN reason IS NULL THEN CAST(coalesce(json_array_length(body, '$.likely_root_cause.assumptions'), 0) AS VARCHAR) END
    AS n_assumptions
FROM v"""


ORACLES: dict[str, str] = {
    "parse_fields": with_ev(FLAT_ENTRIES),
    "parse_fields_doc": with_doc(FLAT_ENTRIES),
    "parse_branches": with_branches(FLAT_ENTRIES),
    "line_numbering": with_doc("SELECT source, line_number, raw FROM entries"),
    "file_scan": with_ev_files(FLAT_ENTRIES),
    "access_lines": with_ev(f"""SELECT source, line_number, client_ip, http_status, {iso('ts_val')} AS ts, message
FROM entries WHERE entry_type = 'access_log'"""),
    "structured_lines": with_ev(f"""SELECT source, line_number, level, {iso('ts_val')} AS ts, thread_name, trace_id,
  request_id, logger, message FROM entries WHERE entry_type = 'structured'"""),
    "context_fill": with_ev("""SELECT source, line_number, entry_type, level, request_id, thread_name, logger, trace_id
FROM entries WHERE entry_type IN ('exception', 'stack_trace')"""),
    "overview": with_ev(OVERVIEW),
    "overview_doc": with_doc(OVERVIEW),
    "first_values": with_ev(FIRST_VALUES),
    "stats_levels": with_ev(STATS_LEVELS),
    "stats_top10": with_ev(STATS_TOP10),
    "error_groups": with_ev(groups_sql(f"level IN {ERR}", P.UNKNOWN_ERROR)),
    "warning_groups": with_ev(groups_sql("level = 'WARNING'", P.UNKNOWN_WARNING)),
    "timeline": with_ev(TIMELINE),
    "timeline_doc": with_doc(TIMELINE),
    "signals": with_ev(signals_sql()),
    "signals_doc": with_doc(signals_sql()),
    "signals_rules": with_ev(signals_sql(CUSTOM_RULES)),
    "evidence_rules": with_ev(evidence_ctes(CUSTOM_RULES) + EVIDENCE_ROWS),
    "snippets": with_ev(SNIPPETS),
    "evidence_lines": with_ev(EVIDENCE),
    "report_sections": with_ev(report_sections_sql()),
    "report_sections_doc": with_doc(report_sections_sql()),
    "model_choice": model_choice_sql(),
    "model_report": with_ev(model_report_sql()),
    "evidence_bundle": with_ev(evidence_bundle_sql()),
    "prompt": with_ev(prompt_sql()),
    "refinement": with_ev(refinement_sql()),
    "report_json": with_ev(report_json_sql()),
    "admission": with_ev_files(ADMISSION),
    "file_reports": file_reports_sql(),
}
