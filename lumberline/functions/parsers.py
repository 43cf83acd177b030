"""Parsers: regular expressions with named groups that turn messages into fields, in order; the first in scope that matches wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIELDS_PER_ENTRY, PARSER_BYTES
from ..sources.syslog import rfc3339
from .regexes import Regex
from .scalars import at_most, clipped, number, parse_severity
from .structured import enriched, field_key

# strftime's directives in Java's pattern letters.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "h": "MMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "z": "xx", ":z": "xxx", "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS", ".f": "[.SSSSSSSSS]", ".3f": ".SSS", ".6f": ".SSSSSS", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "%": "'%'"}


@dataclass
class Parser:
    regex: str
    name: str = ""
    host: str | None = None
    app: str | None = None
    severities: list[int] = field(default_factory=list)
    level_from: str | None = None
    host_from: str | None = None
    app_from: str | None = None
    message_from: str | None = None
    timestamp_from: str | None = None
    timestamp_format: str | None = None
    keep_generic: bool = False

    def __post_init__(self):
        self.compiled = Regex(self.regex, PARSER_BYTES)
        groups = [n for n in self.compiled.names if n]
        for what in ("level_from", "host_from", "app_from", "message_from", "timestamp_from"):
            if (g := getattr(self, what)) and g not in groups:
                raise ValueError(f"parser {self.name!r}: {what} names the group {g!r}, which the regex does not define")
        if bool(self.timestamp_from) != bool(self.timestamp_format):
            raise ValueError(f"parser {self.name!r}: timestamp_from and timestamp_format need each other")
        if not groups:
            raise ValueError(f"parser {self.name!r}: the regex has no named group, so it would extract nothing")
        if self.timestamp_format and self.timestamp_format not in ("rfc3339", "unix", "unix_ms"):
            java_pattern(self.timestamp_format)

    def group(self, name: str) -> Column:
        """The text of a named group, null if empty."""
        found = F.regexp_extract("message", self.compiled.java, self.compiled.names.index(name) + 1)
        return F.when(found != "", found)


def java_pattern(strftime: str) -> str:
    out, i = [], 0
    while i < len(strftime):
        if strftime[i] != "%":
            c = strftime[i]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
            continue
        key = next((strftime[i + 1 : i + 1 + n] for n in (3, 2, 1) if strftime[i + 1 : i + 1 + n] in STRFTIME), None)
        if key is None:
            raise ValueError(f"{strftime!r} is not a valid strftime pattern")
        out.append(STRFTIME[key])
        i += 1 + len(key)
    return "".join(out).replace("''", "")


def timestamp(text: Column, form: str) -> Column:
    bare = F.trim(text)
    if form == "rfc3339":
        return rfc3339(bare)
    if form == "unix":
        seconds = number(bare)
        return F.when(seconds >= 0, F.floor(seconds * 1000 + 0.5).cast("bigint"))
    if form == "unix_ms":
        ms = bare.try_cast("bigint")
        return F.when(ms >= 0, ms)
    return F.unix_millis(F.try_to_timestamp(bare, F.lit(java_pattern(form))))


def applied(entries: DataFrame, parsers: list[Parser], generic: bool = True) -> DataFrame:
    """Entries after the first parser that fits each, and generic extraction where none did or the parser keeps it."""
    which = F.lit(-1)
    for i, p in reversed(list(enumerate(parsers))):
        fits = F.col("message").rlike(p.compiled.java)
        for column, value in (("host", p.host), ("app", p.app)):
            if value is not None:
                fits = (F.col(column) == value) & fits
        if p.severities:
            fits = F.col("severity").isin(*p.severities) & fits
        which = F.when(F.coalesce(fits, F.lit(False)), i).otherwise(which)
    names = entries.columns
    entries = entries.withColumn("_parser", which)

    def chosen(make, otherwise: Column) -> Column:
        out = otherwise
        for i, p in enumerate(parsers):
            value = make(p)
            if value is not None:
                out = F.when((F.col("_parser") == i) & value.isNotNull(), value).otherwise(out)
        return out

    def fields_of(p: Parser) -> Column:
        keys = list(dict.fromkeys(n for n in p.compiled.names if n and field_key(n)))[:FIELDS_PER_ENTRY]
        found = F.map_filter(F.create_map(*(x for n in keys for x in (F.lit(field_key(n)), clipped(p.group(n))))), lambda _, v: v.isNotNull())
        own = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(found, k))
        return at_most(F.map_concat(found, own))

    made = {
        "fields": chosen(fields_of, F.col("fields")),
        "severity": chosen(lambda p: parse_severity(p.group(p.level_from), levels=True) if p.level_from else None, F.col("severity")).cast("int"),
        "host": chosen(lambda p: p.group(p.host_from) if p.host_from else None, F.col("host")),
        "app": chosen(lambda p: p.group(p.app_from) if p.app_from else None, F.col("app")),
        "ts": chosen(lambda p: timestamp(p.group(p.timestamp_from), p.timestamp_format) if p.timestamp_from else None, F.col("ts")),
        "message": chosen(lambda p: p.group(p.message_from) if p.message_from else None, F.col("message")),
    }
    entries = entries.withColumns(made)
    if generic:
        keeps = [i for i, p in enumerate(parsers) if p.keep_generic]
        some = enriched(F.col("message"), F.col("fields"), missing_only=True)
        none = enriched(F.col("message"), F.col("fields"))
        entries = entries.withColumn("fields", F.when(F.col("_parser") < 0, none).when(F.col("_parser").isin(*keeps) if keeps else F.lit(False), some).otherwise(F.col("fields")))
    return entries.select(*names)
