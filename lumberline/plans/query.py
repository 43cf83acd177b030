"""A query as a value, and its one compiler to a predicate: batch searches and live tails differ in free text only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import matches, matches_whole
from ..functions.scalars import canonical_json, folded, folded_term, globs, number
from . import text as search_text
from .fields import ColumnFilter, FieldFilter, LineFilter, column_filter, parse_expression
from ..model import FIELD_KEY, SEARCH_DEFAULT

@dataclass
class Access:
    """Globs of hosts and apps that a reader may see; empty lists allow all."""

    hosts: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)

    def predicate(self, host: Column, app: Column | None = None) -> Column:
        seen = globs(host, self.hosts) if self.hosts else F.lit(True)
        return seen & globs(app, self.apps) if self.apps and app is not None else seen


@dataclass
class Query:
    q: str = ""
    host: str | None = None
    app: str | None = None
    level: int | None = None
    severities: list[int] | None = None
    since: int | None = None
    until: int | None = None
    cursor: tuple[int, int] | None = None
    fields: list[FieldFilter] = field(default_factory=list)
    message_regex: str | None = None
    lines: list[LineFilter] = field(default_factory=list)
    columns: list[ColumnFilter] = field(default_factory=list)
    host_globs: list[str] | None = None
    access: Access = field(default_factory=Access)
    limit: int = SEARCH_DEFAULT

    def also(self, *expressions: str) -> Query:
        """With more f= expressions."""
        return _with(self, fields=[*self.fields, *map(parse_expression, expressions)])


def _with(q: Query, **new) -> Query:
    return Query(**({k: getattr(q, k) for k in q.__dataclass_fields__} | new))


def resolve_tags(names: list[str], tags: dict[str, list[str]]) -> list[str]:
    """Host patterns of all the tags."""
    unknown = [n for n in names if n not in tags]
    if unknown:
        raise ValueError(f"unknown tag {unknown[0]!r} (known: {', '.join(sorted(tags)) or 'none'})")
    return [p for n in names for p in tags[n]]


def with_trace(q: Query, trace: str) -> Query:
    from ..functions.traces import normalized_id

    return _with(q, fields=[*q.fields, FieldFilter("trace_id", "=", normalized_id(trace))])


def parse_cursor(text: str) -> tuple[int, int]:
    ts, _, row = text.partition(":")
    try:
        return int(ts), int(row)
    except ValueError:
        raise ValueError("cursor must be ts:id") from None


def field_predicate(f: FieldFilter, fields: Column) -> Column:
    value = fields[f.key]
    if f.op == "~":
        return F.coalesce(matches(value, f.value), F.lit(False))
    if f.op in ("=", "!="):
        return F.coalesce(value == f.value if f.op == "=" else value != f.value, F.lit(False))
    left, right = number(value), F.lit(f.number)
    return F.coalesce({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[f.op], F.lit(False))


def line_predicate(f: LineFilter, message: Column) -> Column:
    found = message.contains(f.value) if f.op in ("|=", "!=") else matches(message, f.value)
    return found if f.op in ("|=", "|~") else ~found


def column_predicate(f: ColumnFilter) -> Column:
    column = F.col(f.column)
    return {"=": lambda: column == f.value, "!=": lambda: column != f.value, "=~": lambda: matches_whole(column, f.value), "!~": lambda: ~matches_whole(column, f.value)}[f.op]()


def indexed_text(found: search_text.Search, message: Column, fields: Column) -> Column:
    """Whole tokens without case or diacritics, phrases within the message or within the fields' JSON."""
    of_message, of_fields = folded(message), F.coalesce(folded(canonical_json(fields)), F.lit("  "))

    def has(term: search_text.Term) -> Column | None:
        words = folded_term(term.text)
        if not words:
            return None
        want = f" {words}" if term.prefix else f" {words} "
        return of_message.contains(want) | of_fields.contains(want)

    groups = [[p for p in map(has, g) if p is not None] for g in found.any_of]
    anything = [reduce(lambda a, b: a & b, g) for g in groups if g]
    included = reduce(lambda a, b: a | b, anything) if anything else F.lit(not found.any_of)
    excluded = [p for p in map(has, found.none_of) if p is not None]
    return reduce(lambda a, b: a & ~b, excluded, included)


def live_text(found: search_text.Search, message: Column, fields: Column) -> Column:
    """Substrings in any case of the message and the fields' values."""
    hay = F.lower(F.concat_ws("\n", message, F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: e["value"]), "\n")))
    has = lambda t: hay.contains(t.text.lower())
    included = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(has, g)) for g in found.any_of)) if found.any_of else F.lit(True)
    return reduce(lambda a, t: a & ~has(t), found.none_of, included)


def predicate(q: Query, live: bool = False) -> Column:
    """All conditions, the reader's access first; cheap ones that reach the files' statistics before the others."""
    ts, host, app, severity, message, fields = map(F.col, ("ts", "host", "app", "severity", "message", "fields"))
    parts = [q.access.predicate(host, app)]
    if q.since is not None:
        parts.append(ts >= q.since)
    if q.until is not None:
        parts.append(ts <= q.until)
    if q.cursor:
        parts += [ts <= q.cursor[0], F.struct("ts", "id") < F.struct(F.lit(q.cursor[0]).alias("ts"), F.lit(q.cursor[1]).alias("id"))]
    if q.host is not None:
        parts.append(host == q.host)
    if q.app is not None:
        parts.append(app == q.app)
    if q.level is not None:
        parts.append(severity <= q.level)
    if q.severities is not None:
        parts.append(severity.isin(*q.severities) if q.severities else F.lit(False))
    if q.host_globs is not None:
        parts.append(globs(host, q.host_globs))
    parts += [field_predicate(f, fields) for f in q.fields]
    parts += [column_predicate(f) for f in q.columns]
    parts += [line_predicate(f, message) for f in q.lines]
    if q.message_regex:
        parts.append(matches(message, q.message_regex))
    if found := search_text.parse(q.q):
        parts.append((live_text if live else indexed_text)(found, message, fields))
    return reduce(lambda a, b: a & b, parts)


def selected(logs: DataFrame, q: Query) -> DataFrame:
    return logs.where(predicate(q))


__all__ = ["FIELD_KEY", "Access", "Query", "column_filter", "parse_cursor", "predicate", "resolve_tags", "selected", "with_trace"]
