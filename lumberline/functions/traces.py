"""Trace and span ids among an entry's fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of the two ids, in lower case.
TRACE_ALIASES = ("traceid", "trace-id", "trace.id", "otel.trace_id", "dd.trace_id", "x-b3-traceid", "x-trace-id")
SPAN_ALIASES = ("spanid", "span-id", "span.id", "otel.span_id", "dd.span_id", "x-b3-spanid")
ID_BYTES = 128
#: Version, trace, span and flags; more parts may follow. An id of zeros is none.
_PARENT = r"^[0-9A-Fa-f]{2}-(?!0{32})([0-9A-Fa-f]{32})-(?!0{16})([0-9A-Fa-f]{16})-[0-9A-Fa-f]{2}(?:-.*)?$"
_ID = re.compile(r'[\s"]*(?P<id>(?P<hex>[0-9A-Fa-f]+)|[^\x00-\x1f\x7f-\x9f]*?[^\x00-\x20\x7f-\x9f"])[\s"]*')


def normalized_id(text: str) -> str:
    """The id that a search for ``text`` looks for: what ``normalized`` makes of a column's values."""
    found = _ID.fullmatch(text)
    if found is None or len(found["id"].encode()) > ID_BYTES:
        raise ValueError(f"{text!r} cannot be a trace id")
    return found["id"].lower() if found["hex"] else found["id"]


def normalized(value: Column) -> Column:
    """Trimmed, without quotes, in lower case if hexadecimal; null if empty, too long or with control characters."""
    bare = F.regexp_replace(F.regexp_replace(value, r'^(?U)\s*"*(?U)\s*|(?U)\s*"*(?U)\s*$', ""), "^$", "")
    ok = (bare != "") & (F.octet_length(bare) <= ID_BYTES) & ~bare.rlike(r"\p{Cc}")
    return F.when(ok, F.when(bare.rlike(r"^[0-9A-Fa-f]+\z"), F.lower(bare)).otherwise(bare))


def _not(key: str):
    return lambda k, _: k != key


def with_trace_ids(fields: Column) -> Column:
    """Sets trace_id and span_id from the first alias in key order, or from traceparent; what is there already is normalised."""
    entries = F.array_sort(F.map_entries(fields))

    def named(aliases: tuple[str, ...]) -> Column:
        return F.get(F.filter(entries, lambda e: F.lower(e["key"]).isin(*aliases)), 0)["value"]

    parent = F.trim(named(("traceparent",)))
    both = F.when(parent.rlike(_PARENT), parent)
    found = fields
    for key, aliases, group in (("trace_id", TRACE_ALIASES, 1), ("span_id", SPAN_ALIASES, 2)):
        own = fields[key]
        value = F.when(own.isNotNull(), F.coalesce(normalized(own), own)).otherwise(F.coalesce(normalized(named(aliases)), F.lower(F.regexp_extract(both, _PARENT, group))))
        without = F.map_filter(found, _not(key))
        found = F.when(value.isNotNull(), F.map_concat(without, F.create_map(F.lit(key), value))).otherwise(found)
    return F.when(F.size(fields) > 0, found).otherwise(fields)
