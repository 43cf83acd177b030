"""Maintenance windows and mutes over alerts, and gaps of silence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import globs

MINUTE, DAY = 60_000, 86_400_000
DEFAULT_REASON = "maintenance"


@dataclass
class Once:
    """[since, until), for hosts."""

    hosts: list[str]
    since: int
    until: int
    text: str = ""

    def active(self, host: Column, ts: Column) -> Column:
        return (globs(host, self.hosts) if self.hosts else F.lit(True)) & (ts >= self.since) & (ts < self.until)


@dataclass
class Weekly:
    """From minute to minute of the day in UTC, on days of the week (0 Sunday; none: all); past midnight it is the day before's."""

    hosts: list[str]
    start: int
    end: int
    text: str = ""
    days: list[int] = field(default_factory=list)

    def active(self, host: Column, ts: Column) -> Column:
        minute = F.floor(F.pmod(ts, F.lit(DAY)) / MINUTE)
        day = F.pmod(F.floor(ts / DAY) + 4, F.lit(7))
        on = lambda d: F.coalesce(d.isin(*self.days), F.lit(False)) if self.days else F.lit(True)
        if self.start < self.end:
            inside = (minute >= self.start) & (minute < self.end) & on(day)
        else:
            inside = ((minute >= self.start) & on(day)) | ((minute < self.end) & on(F.pmod(day + 6, F.lit(7))))
        return (globs(host, self.hosts) if self.hosts else F.lit(True)) & inside


def reason(host: Column, ts: Column, windows: list[Once | Weekly]) -> Column:
    """The text of the first window that covers an alert, or null."""
    found = F.lit(None).cast("string")
    for w in reversed(windows):
        found = F.when(w.active(host, ts), F.lit(w.text or DEFAULT_REASON)).otherwise(found)
    return found


def muted(alerts: DataFrame, mutes: dict[str, tuple[int, str]], windows: list[Once | Weekly]) -> DataFrame:
    """alerts (ts, rule, host) with ``muted``: why each is not sent, a mute of its rule before maintenance of its host; null if sent."""
    of_rule = F.lit(None).cast("string")
    for rule, (until, text) in mutes.items():
        of_rule = F.when((F.col("rule") == rule) & (F.col("ts") < until), F.lit(text or "muted")).otherwise(of_rule)
    return alerts.withColumn("muted", F.coalesce(of_rule, reason(F.col("host"), F.col("ts"), windows)))


def silence_gaps(logs: DataFrame, threshold: int) -> DataFrame:
    """host, last and gap of every pause longer than threshold between two entries of a host.

    Minutes are reduced to their first and last entry before the window, so that a busy host sends no more than its minutes.
    """
    ends = logs.groupBy("host", F.floor(F.col("ts") / MINUTE).alias("minute")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = Window.partitionBy("host").orderBy("minute")
    between = ends.select("host", "last", (F.lead("first").over(order) - F.col("last")).alias("gap"))
    if threshold < MINUTE:
        raise ValueError("a silence threshold is a minute or more")
    return between.where(F.col("gap") > threshold)
