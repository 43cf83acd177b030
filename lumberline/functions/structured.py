"""Fields read out of messages: JSON objects with dotted keys, or logfmt; an Arrow function, for JSON nests."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FIELDS_PER_ENTRY, KEY_BYTES, STRUCTURED_BYTES, VALUE_BYTES

DEPTH = 3
_PAIR = re.compile(r'(?P<key>[A-Za-z_][A-Za-z0-9_.-]*)=(?:"(?P<quoted>(?:[^"\\]|\\.)*(?:\\\Z)?)(?:"|\Z)|(?P<bare>[^\s\x85\xa0]*))|(?P<word>\S+)', re.S)
_UNQUOTE = re.compile(r"\\(.?)", re.S)


def clip(text: str, most: int = VALUE_BYTES) -> str:
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def field_key(key: str) -> str | None:
    key = re.sub(r"[^A-Za-z0-9_.-]", "_", key)[:KEY_BYTES]
    return key if key.strip("_") else None


def number_text(n: int | float) -> str:
    return repr(n).replace("e+", "e") if isinstance(n, float) else str(n)


def scalar_text(v: object) -> str | None:
    """Text of a JSON string, number or boolean."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    return v if isinstance(v, str) else None


def flattened(value: object) -> dict[str, str]:
    out: dict[str, str] = {}

    def walk(prefix: str, value: object, depth: int) -> None:
        if isinstance(value, dict):
            if depth < DEPTH:
                for k in sorted(value):
                    if len(out) < FIELDS_PER_ENTRY and (key := field_key(k)):
                        walk(f"{prefix}.{key}" if prefix else key, value[k], depth + 1)
        elif (text := scalar_text(value)) and len(out) < FIELDS_PER_ENTRY:
            out.setdefault(field_key(prefix), clip(text))

    walk("", value, 0)
    return out


def logfmt(text: str) -> dict[str, str]:
    """Pairs, if there are two at least and as many as bare words."""
    pairs, bare = [], 0
    for m in _PAIR.finditer(text):
        if m["key"] is None:
            bare += 1
        elif m["quoted"] is not None:
            pairs.append((m["key"], _UNQUOTE.sub(lambda e: {"n": "\n", '"': '"', "\\": "\\", "": "\\"}.get(e[1], e[0]), m["quoted"])))
        else:
            pairs.append((m["key"], m["bare"]))
    out: dict[str, str] = {}
    if len(pairs) >= max(2, bare):
        for k, v in pairs:
            if v and len(out) < FIELDS_PER_ENTRY and (key := field_key(k)):
                out.setdefault(key, clip(v))
    return out


def extract(message: str | None) -> dict[str, str]:
    text = (message or "").strip()
    if not text or len(text.encode("utf-8", "replace")) > STRUCTURED_BYTES:
        return {}
    if text.startswith("{") and text.endswith("}"):
        try:
            if found := flattened(json.loads(text)):
                return found
        except (ValueError, RecursionError):
            pass
    return logfmt(text) or (logfmt(text.split("\n", 1)[0]) if "\n" in text else {})


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def extracted(message: pd.Series) -> pd.Series:
    return message.map(lambda m: extract(m))


def may_hold_fields(message: Column) -> Column:
    return message.contains("=") | message.contains("{")


def enriched(message: Column, fields: Column, missing_only: bool = False) -> Column:
    """Fields of the message where the entry has none; or, missing_only, under keys that it lacks, 64 in all."""
    empty = F.coalesce(F.size(fields), F.lit(0)) <= 0
    found = F.when(may_hold_fields(message), extracted(message))
    if not missing_only:
        return F.when(empty & (F.size(found) > 0), found).otherwise(fields)
    own = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    new = F.map_filter(F.coalesce(found, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    room = F.greatest(F.lit(0), F.lit(FIELDS_PER_ENTRY) - F.size(own))
    return F.map_concat(own, F.map_from_entries(F.slice(F.map_entries(new), 1, room)))
