"""Schemas, severity vocabularies and the limits that are part of query semantics."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Names of the eight severities, other words for them, words of the level label, and limits of the query surface.
SEVERITIES = ("emerg", "alert", "crit", "err", "warn", "notice", "info", "debug")
SEVERITY_WORDS = {"emergency": 0, "critical": 2, "error": 3, "warning": 4}
LEVEL_WORDS = {"trace": 7, "dbg": 7, "information": 6, "fatal": 0, "panic": 0}
LEVELS = ("critical", "critical", "critical", "error", "warning", "info", "info", "debug")
HOST_LABELS = ("host", "hostname")
APP_LABELS = ("app", "service_name", "service", "job")
LEVEL_LABELS = ("level", "severity", "detected_level", "log_level")
SEARCH_DEFAULT, SEARCH_MAX = 100, 1000
TOP_DEFAULT, TOP_MAX = 10, 100
PATTERNS_DEFAULT, PATTERNS_MAX, PATTERN_ROWS, PATTERN_CHARS, PATTERN_TEMPLATES, PATTERN_HOSTS = 25, 200, 20_000, 400, 5_000, 100
FIELDS_DEFAULT, FIELDS_MAX = 50, 200
CONTEXT_DEFAULT, CONTEXT_MAX = 5, 100
LINES_DEFAULT, LINES_MAX, POINTS_MAX, SERIES_MAX = 100, 5_000, 11_000, 1_000
TRACES_DEFAULT, TRACES_MAX = 50, 500
ALERTS_DEFAULT, ALERTS_MAX = 50, 1_000
AUDIT_DEFAULT, AUDIT_MAX = 100, 10_000
BUCKETS_MAX, GROUPS_MAX, OTHER = 2_000, 10, "other"
AUTO_BUCKETS_S = (10, 30, 60, 300, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400, 604_800)
REGEX_BYTES, PARSER_BYTES = 500, 4096
NAME_BYTES, METRIC_SERIES = 255, 200
FIELDS_PER_ENTRY, KEY_BYTES, VALUE_BYTES, MESSAGE_BYTES, STRUCTURED_BYTES = 64, 64, 1024, 16_384, 65_536

FIELD_KEY = re.compile(r"[A-Za-z0-9_.-]{1,64}\Z")

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("app", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
ENTRY = T.StructType(LOGS.fields[1:])
SPANS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("trace_id", "span_id", "parent_id", "name")]
    + [T.StructField("kind", T.IntegerType()), T.StructField("service", T.StringType()), T.StructField("host", T.StringType())]
    + [T.StructField("start_us", T.LongType()), T.StructField("duration_us", T.LongType()), T.StructField("status", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("status_message", "attributes", "events")]
)


def parse_severity(word: str) -> int | None:
    """A severity by number, name or another word for it."""
    w = word.strip().lower()
    if w in SEVERITIES:
        return SEVERITIES.index(w)
    if w in SEVERITY_WORDS:
        return SEVERITY_WORDS[w]
    return int(w) if re.fullmatch(r"[0-7]", w) else None


def level_severity(word: str) -> int | None:
    """The same with the words that loggers use for levels."""
    found = parse_severity(word)
    return LEVEL_WORDS.get(word.strip().lower()) if found is None else found
