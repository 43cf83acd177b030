"""Rules on entries, in order: masks rewrite message and fields, drops remove what is in scope and matches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regexes import matches, replaced
from .scalars import globs


def scope(hosts: list[str], apps: list[str], severities: list[int]) -> Column:
    found = F.lit(True)
    if hosts:
        found = found & globs(F.col("host"), hosts)
    if apps:
        found = found & globs(F.col("app"), apps)
    return found & F.col("severity").isin(*severities) if severities else found


@dataclass
class Mask:
    pattern: str
    by: str
    hosts: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)
    severities: list[int] = field(default_factory=list)


@dataclass
class Drop:
    pattern: str | None = None
    hosts: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)
    severities: list[int] = field(default_factory=list)


def _value_mask(rule: Mask):
    return lambda _, value: replaced(value, rule.pattern, rule.by)


def applied(entries: DataFrame, rules: list[Mask | Drop]) -> DataFrame:
    """Entries after all rules; each sees what those before it made."""
    for rule in rules:
        inside = F.coalesce(scope(rule.hosts, rule.apps, rule.severities), F.lit(False))
        if isinstance(rule, Mask):
            message = replaced(F.col("message"), rule.pattern, rule.by)
            fields = F.transform_values("fields", _value_mask(rule))
            entries = entries.withColumns({"message": F.when(inside, message).otherwise(F.col("message")), "fields": F.when(inside, fields).otherwise(F.col("fields"))})
        else:
            hit = inside & matches(F.col("message"), rule.pattern) if rule.pattern else inside
            entries = entries.where(~F.coalesce(hit, F.lit(False)))
    return entries
