"""Texts and payloads of notifications, from their columns: kind, host, rule, count, usual, window_secs, sample, ..."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import duration_text, one_line

# Names of the notifications, and how a push service shows each: priority and tag.
EVENTS = {"silent": "host_silent", "recovered": "host_recovered", "alert": "log_alert", "new": "new_pattern", "surge": "pattern_surge", "volume_surge": "volume_surge", "volume_drop": "volume_drop"}
PUSH = {"silent": ("high", "warning"), "recovered": ("default", "white_check_mark"), "alert": ("high", "rotating_light"), "new": ("high", "new"), "surge": ("high", "chart_with_upwards_trend"), "volume_surge": ("high", "chart_with_upwards_trend"), "volume_drop": ("high", "chart_with_downwards_trend")}


def _s(x: Column) -> Column:
    return x.cast("string")


def message(kind: Column, host: Column, rule: Column, count: Column, usual: Column, seconds: Column, threshold: Column, sample: Column) -> Column:
    """seconds: of silence, or the window; rule: the alert's name, or the template."""
    sample, window = one_line(sample), duration_text(seconds)
    on = F.coalesce(F.concat(F.lit(" on "), host), F.lit(""))
    return (
        F.when(kind == "silent", F.concat(F.lit("No logs from "), host, F.lit(" for "), window, F.lit(" (threshold "), duration_text(threshold), F.lit(")")))
        .when(kind == "recovered", F.concat(host, F.lit(" is sending logs again")))
        .when(kind == "alert", F.concat(F.lit("Alert "), rule, F.lit(": "), _s(count), F.lit(" matching entries within "), window, on, F.lit(". Last: "), sample))
        .when(kind == "new", F.concat(F.lit("New log pattern on "), host, F.lit(": "), rule, F.lit(". Example: "), sample))
        .when(kind == "surge", F.concat(F.lit("Pattern surge: "), rule, F.lit(" seen "), _s(count), F.lit(" times within "), window, F.lit(" (usually about "), _s(usual), F.lit("). Last: "), sample))
        .when(kind == "volume_surge", F.concat(host, F.lit(" sent "), _s(count), F.lit(" entries in "), window, F.lit(", far above its usual "), _s(usual)))
        .when(kind == "volume_drop", F.concat(host, F.lit(" sent "), _s(count), F.lit(" entries in "), window, F.lit(", far below its usual "), _s(usual)))
    )


def rendered(form: str, kind: Column, text: Column, payload: Column, title: Column | None = None) -> Column:
    """Body for a receiver: json (the payload), text, slack, discord or ntfy."""
    if form == "json":
        return payload
    if form in ("text", "ntfy"):
        return text
    if form == "slack":
        escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.to_json(F.struct(escaped.alias("text")))
    if form == "discord":
        return F.to_json(F.struct(text.alias("content"), F.struct(F.array().cast("array<string>").alias("parse")).alias("allowed_mentions")))
    raise ValueError(f"unknown format {form!r}")


def push_headers(kind: Column, title: Column) -> Column:
    """Title (printable ASCII), priority and tag of a pushed notification."""
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in PUSH.items() for x in (k, v[i])))[kind]
    return F.create_map(F.lit("Title"), F.regexp_replace(title, "[^ -~]", "?"), F.lit("Priority"), pick(0), F.lit("Tags"), pick(1))
