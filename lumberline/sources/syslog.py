"""Syslog lines of RFC 5424 and RFC 3164, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import zones

# The months of RFC 3164.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DEFAULT_SEVERITY = 6
DAY = 86_400_000
_DATA = r"(?s)^((?:\[(?:[^\]\"\\]|\\.|\"(?:[^\"\\]|\\.)*+\")*+\])*+)(.*)\z"
_STAMP = rf"^(?:{'|'.join(MONTHS)}) [ 0-9][0-9] ..:..:.. "
_TAG = r"(?s)^([^ :]{1,48}):(.*)\z"
_RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)\z"


def _from(text: Column, at: Column | int) -> Column:
    return F.substring(text, F.lit(at) if isinstance(at, int) else at, F.lit(2**30))


def pri(line: Column) -> tuple[Column, Column]:
    """Severity, and what follows the priority."""
    digits = F.when(line.startswith("<"), F.regexp_extract(line, r"^<(\d{1,3})>", 1))
    ok = digits.try_cast("int") <= 191
    return F.when(ok, digits.cast("int") % 8).otherwise(DEFAULT_SEVERITY), F.when(ok, _from(line, F.length(digits) + 3)).otherwise(line)


def rfc3339(text: Column) -> Column:
    """Milliseconds, or null."""
    clean = F.regexp_replace(F.upper(text), r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(_RFC3339), F.unix_millis(F.try_to_timestamp(F.regexp_replace(clean, " ", "T"))))


def message_5424(rest: Column, tail: Column) -> Column:
    """What follows structured data (tail: what follows its elements); all of it if an element has no end."""
    bare = lambda text: F.when(text.startswith(" "), _from(text, 2)).otherwise(text)
    found = F.when(rest.startswith("-"), bare(_from(rest, 2))).when(tail.startswith("["), rest).otherwise(bare(F.coalesce(tail, rest)))
    return F.when(found.startswith("\ufeff"), F.regexp_replace(found, "^\ufeff+", "")).otherwise(found)


def stamp_3164(text: Column, now: Column, zone: str) -> Column:
    """The stamp in a zone, in this year or, if that is more than a day ahead, the last; null without one."""
    to_ms = zones.parse(zone)
    if to_ms is None:
        return F.lit(None).cast("bigint")
    part = lambda a, n: F.trim(F.substring(text, a, n)).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(text, 1, 3)).cast("int")
    valid = (part(8, 2) < 24) & (part(11, 2) < 60) & (part(14, 2) < 60)

    def at(year: Column) -> Column:
        day = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, part(5, 2)), "yyyy-MM-dd")
        wall = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + part(8, 2) * 3600 + part(11, 2) * 60 + part(14, 2)
        return F.when(valid, to_ms(wall, year))

    this = F.year(F.timestamp_millis(now))
    found = at(this)
    return F.when(found > now + DAY, F.coalesce(at(this - 1), found)).otherwise(found)


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """The frame with columns that are computed once: a generator of one row, into which the optimiser inlines nothing."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def entries(lines: DataFrame, zone: str = "reception") -> DataFrame:
    """Entries of lines (line, peer, arrival); lines without a message stay out.

    Each line is cut once, as far as both formats agree; what only one of them has is under the test of the format.
    """
    found = _once(lines.select("line", "peer", "arrival"), text=F.rtrim("line", F.lit("\n\r\0")))
    severity, rest = pri(F.col("text"))
    found = _once(found.drop("line"), severity=severity, rest=rest).drop("text")
    new, old = F.col("new"), F.col("old")
    parts = F.split("rest", " ", 7)  # version, time, host, app, process, message id, and all the rest
    modern = F.col("rest").startswith("1 ") & (F.size(parts) > 5)
    stamped = F.col("rest").rlike(_STAMP) & (F.octet_length("rest") > 16)
    found = _once(found, new=F.when(modern, parts), stamped=F.when(~modern, stamped))
    after = F.when(F.col("stamped"), _from(F.col("rest"), 17))
    space = F.instr(after, " ")
    host = F.when(space > 0, F.substring(after, F.lit(1), space - 1)).otherwise(F.col("peer"))
    body = F.when(space > 0, _from(after, space + 1)).otherwise(F.coalesce(after, "rest"))
    tail = F.when(F.get(new, 6).startswith("["), F.regexp_extract(F.get(new, 6), _DATA, 2))
    found = _once(found, tail=tail, old=F.when(new.isNull(), F.struct(host.alias("host"), body.alias("body"), F.regexp_extract(body, _TAG, 1).alias("tag"))))
    tagged = old["tag"] != ""
    named = lambda i, other: F.when(new[i] == "-", other).otherwise(new[i])
    found = found.select(
        F.coalesce(F.when(new.isNotNull(), F.when(new[1] != "-", rfc3339(new[1]))).otherwise(F.when(F.col("stamped"), stamp_3164(F.col("rest"), F.col("arrival"), zone))), "arrival").alias("ts"),
        F.when(new.isNotNull(), named(2, F.col("peer"))).otherwise(old["host"]).alias("host"),
        F.when(new.isNotNull(), named(3, F.lit(""))).otherwise(F.substring_index(old["tag"], "[", 1)).alias("app"),
        F.col("severity").cast("int").alias("severity"),
        F.when(new.isNotNull(), message_5424(F.coalesce(F.get(new, 6), F.lit("")), F.col("tail"))).otherwise(F.when(tagged, F.regexp_replace(_from(old["body"], F.length(old["tag"]) + 2), r"^(?U)\s+", "")).otherwise(old["body"])).alias("message"),
        F.lit(None).cast("map<string,string>").alias("fields"),
        "arrival",
    )
    return found.where("message != ''")
