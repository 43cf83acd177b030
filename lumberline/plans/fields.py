"""Filters as values: field comparisons, line filters and column matchers, and the f= expressions that name the first."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from ..functions.regexes import check
from ..model import FIELD_KEY

_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")
_EXPRESSION = re.compile(r"(?P<key>[A-Za-z0-9_.-]*)(?P<op>!=|>=|<=|[:=><~])(?P<value>.*)\Z", re.S)
FORMS = "f must be key:value, key!=value, key>=number (also >, <, <=) or key~regex"


@dataclass(frozen=True)
class FieldFilter:
    """op: = != > >= < <= ~ ; an entry without the field never matches."""

    key: str
    op: str
    value: str

    @property
    def number(self) -> float | None:
        return parse_number(self.value)


@dataclass(frozen=True)
class LineFilter:
    """op: |= != |~ !~ on the message."""

    op: str
    value: str


@dataclass(frozen=True)
class ColumnFilter:
    """column: host or app; op: = != =~ !~, regular expressions over the whole value."""

    column: str
    op: str
    value: str


def parse_number(text: str) -> float | None:
    text = text.strip()
    if not _NUMBER.match(text):
        return None
    n = float(text)
    return n if math.isfinite(n) else None


def field_filter(key: str, op: str, value: str) -> FieldFilter:
    if not FIELD_KEY.match(key):
        raise ValueError(f"invalid field name {key!r}")
    if op in (">", ">=", "<", "<=") and parse_number(value) is None:
        raise ValueError(f"{value!r} is not a number")
    if op == "~":
        check(value)
    return FieldFilter(key, op, value)


def parse_expression(text: str) -> FieldFilter:
    """key:value, key=value, key!=value, key>=number (also > < <=), key~regex."""
    m = _EXPRESSION.match(text)
    if m is None:
        raise ValueError(FORMS)
    return field_filter(m["key"], "=" if m["op"] == ":" else m["op"], m["value"])


def line_filter(op: str, value: str) -> LineFilter:
    if op in ("|~", "!~"):
        check(value)
    return LineFilter(op, value)


def column_filter(column: str, op: str, value: str) -> ColumnFilter:
    if op in ("=~", "!~"):
        check(f"^(?:{value})$")
    return ColumnFilter(column, op, value)
