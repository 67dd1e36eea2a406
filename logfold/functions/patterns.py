"""Fixed values shared by the parser, the rules and the report.

Everything in the block marked FIXED VALUES must stay equal to the behaviour
being reproduced (level words, keyword lists, sentences, limits).  The regex
fragments below it are written for the Java engine Spark uses; they spell
out the character classes explicitly so that a line gives the same answer as
a Python ``str`` regex would (Unicode ``\\s``, ``\\w``, ``\\d`` and ``\\b``).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Level words recognised in log lines, in the order they are tried.
LEVEL_WORDS = ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL", "TRACE")
# Normalised levels that count as a known level.
KNOWN_LEVELS = ("ERROR", "WARNING", "INFO", "DEBUG", "TRACE", "CRITICAL", "FATAL")
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")
WARNING_LEVEL = "WARNING"
TIMELINE_LEVELS = ("ERROR", "WARNING", "CRITICAL", "FATAL")
# Bracketed words that are never a logger name (compared in lower case).
LOGGER_SKIP_WORDS = ("info", "warn", "warning", "error", "debug", "trace", "critical", "fatal")
# Component keys, tried in this order (not by position in the line).
COMPONENT_TOKENS = ("Service", "Component", "Controller", "Worker", "Scheduler", "DB", "Cache", "API")
# Lifecycle keywords for evidence lines (substring test on lower-cased message).
LIFECYCLE_KEYWORDS = (
    "start", "started", "shutdown", "stop", "connect", "connected",
    "ready", "listen", "deploy", "config", "initialized", "bootstrap",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

UNKNOWN_ERROR = "unknown_error"
UNKNOWN_WARNING = "unknown_warning"
ERROR_EXPLANATION = "Repeated error condition observed in logs."
WARNING_EXPLANATION = "Repeated warning condition observed in logs."

# Limits.
TIMELINE_LIMIT = 12
TIMELINE_MESSAGE_CHARS = 200
GROUP_LABEL_CHARS = 120
PRIMARY_ISSUE_CHARS = 160
SNIPPET_PREFIX_CHARS = 40
SNIPPET_GROUPS = 3
SNIPPET_LIMIT = 5
FIRST_VALUES_LIMIT = 10
TOP_VALUES_LIMIT = 10
FACT_GROUPS = 3
FACT_LIST_LIMIT = 5
RECOMMENDATION_LIMIT = 6
ANALYZER_PATTERN_LIMIT = 8
EVIDENCE_LEVEL_LINES = 150
EVIDENCE_SAMPLE_LINES = 500
EVIDENCE_HEAD_TAIL = 50
ALLOWED_EXTENSIONS = (".log", ".txt")

# Analyzer sentences.
SENT_ERROR_EVENTS = "{n} error events detected."
SENT_WARNING_EVENTS = "{n} warning events detected."
SENT_TIMEOUT_MESSAGES = "Timeout-related messages were observed."
SENT_RETRY_ACTIVITY = "Retry activity appears in the logs."
SENT_WARN_WITH_ERRORS = "Warnings preceded or accompanied error activity."
SENT_SHUTDOWN_EVENTS = "Shutdown-related events were detected."

# Detector rules: (sentence, keywords any of which must occur in lower(message)), in order.
DETECTOR_PATTERN_RULES = (
    ("Repeated retries detected.", ("retry",)),
    ("Timeout loop signatures were found.", ("timeout",)),
    ("Connection-related issues appear in the logs.", ("connection",)),
    ("Thread-pool exhaustion may be a factor.", ("thread pool", "pool exhausted")),
    ("Garbage collection activity was observed.", ("gc", "garbage")),
    ("Memory pressure indicators are present.", ("memory",)),
)
DETECTOR_ANOMALY_RULES = (
    ("Unexpected shutdown or termination was observed.", ("unexpected shutdown", "shutdown")),
    ("Connection failures were seen in the execution flow.", ("connection refused", "connection reset")),
    ("Recurring exception patterns may indicate systemic instability.", ("exception",)),
)

# Report sentences.
SUMMARY_EMPTY = "No log entries were found. The file may be empty or unparsable."
SUMMARY_COUNT = "The log contains {n} parsed line(s) with levels {levels}."
SUMMARY_RANGE = "Time range: {range}."
SUMMARY_HEALTH = "Execution appears {health} with {errors} error occurrence(s) and {warnings} warning occurrence(s)."
SUMMARY_PRIMARY = "Primary issue: {label}."
FACT_GROUP = "{label} occurred {n} time(s) between {first} and {last}."
CAUSE_RULES = (
    ("timeout", "Downstream dependency latency or network timeout."),
    ("connection", "Connectivity issue between services or to infrastructure."),
    ("memory", "Memory pressure affecting service stability."),
)
CAUSE_DEFAULT = "Recurring application error path in the dominant error message."
ASSUMPTION_NO_FACTS = "No strong failure signals were detected; health assessment is based on limited evidence."
REC_ERRORS = "Inspect the earliest occurrence of the top error group and correlate with deployment or config changes."
REC_WARNINGS = "Review warning trends that precede errors to identify early degradation signals."
REC_PATTERN_RULES = (
    ("timeout", "Verify network connectivity and timeout settings for affected dependencies."),
    ("connection", "Check service endpoints, credentials, and firewall rules for connection failures."),
    ("memory", "Inspect memory usage, GC behavior, and container limits for the affected service."),
)
REC_DEFAULT = "Collect additional logs around the reported time range if behavior remains unclear."

# Model-assisted analysis prompt text.
SYSTEM_PROMPT = (
    "You are an on-call log analysis agent. "
    "Return only valid JSON matching the requested schema. "
    "Be concise, evidence-based, and avoid speculation."
)
ANALYSIS_RULES = (
    "Rules:\n"
    "- Use only evidence from the provided log material.\n"
    "- Ignore repetitive noise and merge duplicate events.\n"
    "- Do not invent patterns, causes, or events unsupported by evidence.\n"
    "- Separate facts from assumptions in likely_root_cause.\n"
    "- Keep executive_summary readable in under one minute.\n"
    "- Return valid JSON only, matching the schema exactly."
)
ANALYSIS_PROMPT_HEAD = (
    "You are an on-call log analysis agent.\n"
    "Analyze ONLY the evidence below and produce a structured incident report.\n"
)
REFINEMENT_PROMPT_HEAD = (
    "Refine this structured log analysis report for clarity and actionability. "
    "Return valid JSON with the same schema.\n"
)
REPORT_SCHEMA_TEXT = {
    "executive_summary": "string",
    "log_overview": {
        "time_range": "string|null",
        "total_lines_processed": "integer",
        "log_levels_observed": ["string"],
        "major_components": ["string"],
        "request_identifiers": ["string"],
        "thread_names": ["string"],
    },
    "timeline": [{"timestamp": "string|null", "message": "string", "source": "string|null"}],
    "error_analysis": [
        {
            "error_type": "string",
            "occurrence_count": "integer",
            "first_occurrence": "string|null",
            "last_occurrence": "string|null",
            "short_explanation": "string",
        }
    ],
    "warning_analysis": [
        {
            "warning_type": "string",
            "occurrence_count": "integer",
            "first_occurrence": "string|null",
            "last_occurrence": "string|null",
            "short_explanation": "string",
        }
    ],
    "pattern_detection": ["string"],
    "anomalies": ["string"],
    "likely_root_cause": {
        "observed_facts": ["string"],
        "possible_causes": ["string"],
        "assumptions": ["string"],
    },
    "recommendations": ["string"],
    "interesting_log_snippets": ["string"],
}

# ---------------------------------------------------------------------------
# Character classes (Java regex), equal to Python's Unicode str classes.
# ---------------------------------------------------------------------------

# Python str.isspace(): ASCII controls 9-13 and 28-31, space, NEL, NBSP and the
# Unicode space separators.
WS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"  # Python \w for str: letters, numbers, underscore
NOT_WORD = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"  # Python \d for str: decimal digits
WB_BEFORE = r"(?<![\p{L}\p{N}_])"  # \b in front of a word character
WB_AFTER = r"(?![\p{L}\p{N}_])"  # \b behind a word character

# Line separators beyond \n, \r and \r\n that str.splitlines() honours.
EXTRA_LINE_SEPARATORS = r"[\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
# All separators, for text held in a table column.
ALL_LINE_SEPARATORS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

LEVEL_ALT = "|".join(LEVEL_WORDS)
