"""The report shape as plain Python, to compare the column checks with."""

from __future__ import annotations

import re
from typing import Any

_REQUIRED = object()
_WHOLE = re.compile(r"[+-]?\d+(?:\.0+)?")


class ShapeError(ValueError):
    pass


def _str(v, path, optional=False):
    if v is None and optional:
        return None
    if not isinstance(v, str):
        raise ShapeError(f"{path}: input should be a valid string")
    return v


def _int(v, path):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, str) and len(v) < 100 and _WHOLE.fullmatch(v.strip()):
        return int(v.strip().partition(".")[0])
    raise ShapeError(f"{path}: input should be a valid integer")


def _strs(v, path):
    if not isinstance(v, list):
        raise ShapeError(f"{path}: input should be a valid list")
    return [_str(x, f"{path}.{i}") for i, x in enumerate(v)]


def _obj(v, path):
    if not isinstance(v, dict):
        raise ShapeError(f"{path}: input should be a valid dictionary")
    return v


def _field(d, key, conv, path, default=_REQUIRED):
    if key not in d:
        if default is _REQUIRED:
            raise ShapeError(f"{path}{key}: field required")
        return default() if callable(default) else default
    return conv(d[key], f"{path}{key}")


def _items(v, path, item):
    if not isinstance(v, list):
        raise ShapeError(f"{path}: input should be a valid list")
    return [item(_obj(x, f"{path}.{i}"), f"{path}.{i}.") for i, x in enumerate(v)]


def _group(kind):
    def conv(d, p):
        return {
            kind: _field(d, kind, _str, p),
            "occurrence_count": _field(d, "occurrence_count", _int, p),
            "first_occurrence": _field(d, "first_occurrence", lambda v, q: _str(v, q, True), p, None),
            "last_occurrence": _field(d, "last_occurrence", lambda v, q: _str(v, q, True), p, None),
            "short_explanation": _field(d, "short_explanation", _str, p, ""),
        }
    return conv


def validate_report(payload: Any) -> dict:
    """Normalised report dict, or :class:`ShapeError` (unknown fields are ignored)."""
    d = _obj(payload, "report")

    def overview(v, p):
        o = _obj(v, p)
        q = p + "."
        return {
            "time_range": _field(o, "time_range", lambda x, r: _str(x, r, True), q, None),
            "total_lines_processed": _field(o, "total_lines_processed", _int, q, 0),
            "log_levels_observed": _field(o, "log_levels_observed", _strs, q, list),
            "major_components": _field(o, "major_components", _strs, q, list),
            "request_identifiers": _field(o, "request_identifiers", _strs, q, list),
            "thread_names": _field(o, "thread_names", _strs, q, list),
        }

    def event(e, p):
        return {
            "timestamp": _field(e, "timestamp", lambda x, r: _str(x, r, True), p, None),
            "message": _field(e, "message", _str, p),
            "source": _field(e, "source", lambda x, r: _str(x, r, True), p, None),
        }

    def cause(v, p):
        o = _obj(v, p)
        q = p + "."
        return {k: _field(o, k, _strs, q, list) for k in ("observed_facts", "possible_causes", "assumptions")}

    empty_cause = {"observed_facts": [], "possible_causes": [], "assumptions": []}
    return {
        "executive_summary": _field(d, "executive_summary", _str, ""),
        "log_overview": _field(d, "log_overview", overview, ""),
        "timeline": _field(d, "timeline", lambda v, p: _items(v, p, event), "", list),
        "error_analysis": _field(d, "error_analysis", lambda v, p: _items(v, p, _group("error_type")), "", list),
        "warning_analysis": _field(d, "warning_analysis", lambda v, p: _items(v, p, _group("warning_type")), "",
                                   list),
        "pattern_detection": _field(d, "pattern_detection", _strs, "", list),
        "anomalies": _field(d, "anomalies", _strs, "", list),
        "likely_root_cause": _field(d, "likely_root_cause", cause, "", lambda: dict(empty_cause)),
        "recommendations": _field(d, "recommendations", _strs, "", list),
        "interesting_log_snippets": _field(d, "interesting_log_snippets", _strs, "", list),
    }
