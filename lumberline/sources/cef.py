"""CEF records in messages: seven header fields and an extension of key=value pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.structured import clip
from ..model import FIELDS_PER_ENTRY, KEY_BYTES
from ..plans.durations import rfc3339_ms

# Names of the header's fields.
HEADER = ("cef_version", "cef_vendor", "cef_product", "cef_device_version", "cef_signature_id", "cef_name", "cef_severity")
_RECORD = re.compile(r"\s*CEF:\s*" + r"((?:[^|\\]|\\.)*)\|" * 7 + r"(.*)\Z", re.S)
_KEY = re.compile(r"(?:^|(?<= ))([A-Za-z0-9_.\-\[\]]+)=")


def _unescaped(text: str, known: dict[str, str]) -> str:
    return re.sub(r"\\(.)", lambda m: known.get(m[1], m[0]), text, flags=re.S)


def extension(text: str) -> list[tuple[str, str]]:
    marks = list(_KEY.finditer(text))
    ends = [m.start() - 1 for m in marks[1:]] + [len(text)]
    escapes = {"n": "\n", "r": "\r", "=": "=", "\\": "\\"}
    return [(m[1], _unescaped(text[m.end() : max(m.end(), end)].rstrip(), escapes)) for m, end in zip(marks, ends, strict=True)]


def parse(text: str) -> tuple[list[str], list[tuple[str, str]]] | None:
    """The seven header fields and the extension, or None."""
    m = _RECORD.match(text)
    if m is None or not re.fullmatch(r"[0-9]+", m[1]):
        return None
    return [_unescaped(x, {"|": "|", "\\": "\\"}) for x in m.groups()[:7]], extension(m[8])


def read(app: str, message: str) -> dict | None:
    """ts (or None), app, message and fields of an entry with a record."""
    found = parse(f"CEF:{message}" if app == "CEF" else message) if app == "CEF" or message.lstrip().startswith("CEF:") else None
    if found is None:
        return None
    header, pairs = found
    fields = {k: clip(v) for k, v in zip(HEADER, header, strict=True)}
    for k, v in pairs:
        if len(fields) < FIELDS_PER_ENTRY and len(k) <= KEY_BYTES:
            fields[k] = clip(v)
    said = next((v for k, v in pairs if k == "msg"), "")
    name = header[5]
    text = f"{name}: {said}" if name and said else name or said or message
    when = fields.get("UNIFIutcTime")
    return {"ts": rfc3339_ms(when) if when else None, "app": header[2] or app, "message": text, "fields": fields}


@F.pandas_udf(T.StructType([T.StructField("ts", T.LongType()), T.StructField("app", T.StringType()), T.StructField("message", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))
def _record(app: pd.Series, message: pd.Series) -> pd.DataFrame:
    found = [read(a or "", m or "") or {"ts": None, "app": None, "message": None, "fields": None} for a, m in zip(app, message, strict=True)]
    return pd.DataFrame({"ts": pd.array([x["ts"] for x in found], dtype="Int64"), "app": [x["app"] for x in found], "message": [x["message"] for x in found], "fields": [x["fields"] for x in found]})


def enriched(entries: DataFrame) -> DataFrame:
    """Entries with a record read into app, message, fields and time; only what may be one goes through Python."""
    maybe = (F.col("app") == "CEF") | F.ltrim("message").startswith("CEF:")
    found = entries.withColumn("_cef", F.when(maybe, _record("app", "message")))
    here = F.col("_cef.message").isNotNull()
    return found.withColumns(
        {
            "ts": F.coalesce(F.when(here, F.col("_cef.ts")), F.col("ts")),
            "app": F.when(here, F.col("_cef.app")).otherwise(F.col("app")),
            "message": F.when(here, F.col("_cef.message")).otherwise(F.col("message")),
            "fields": F.when(here, F.col("_cef.fields")).otherwise(F.col("fields")),
        }
    ).drop("_cef")
