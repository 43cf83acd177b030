"""Message templates with their trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import search_hint, severity_name, template
from ..model import PATTERN_CHARS, PATTERN_HOSTS, PATTERN_ROWS, PATTERN_TEMPLATES, PATTERNS_DEFAULT
from ..plans.query import Query, _with
from .search import search


def sample(logs: DataFrame, q: Query, rows: int = PATTERN_ROWS) -> DataFrame:
    """The newest entries of a query, messages cut: the feature's scan limit, as a top-k."""
    found = search(logs.select("id", "ts", "host", "app", "severity", "message", "fields"), _with(q, limit=rows))
    return found.select("id", "ts", "host", "severity", F.substring("message", 1, PATTERN_CHARS).alias("message"))


def grouped(rows: DataFrame, middle: int, most: int = PATTERN_TEMPLATES) -> DataFrame:
    """template, count, previous (before middle), recent, hosts, severity, first_ts, last_ts, id and message of the newest; the
    ``most`` templates whose newest entry is newest."""
    rows = rows.withColumn("template", template(F.col("message")))
    at = F.struct("ts", "id")
    found = rows.groupBy("template").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("ts") < middle).alias("previous"),
        F.count_if(F.col("ts") >= middle).alias("recent"),
        F.least(F.lit(PATTERN_HOSTS), F.count_distinct("host")).alias("hosts"),
        F.min("severity").alias("severity"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(at).alias("newest"),
        F.max_by("message", at).alias("example"),
    )
    found = found.orderBy(F.col("newest").desc()).limit(most)
    return found.select("template", "count", "previous", "recent", "hosts", severity_name(F.col("severity")).alias("severity"), "first_ts", "last_ts", F.col("newest.id").alias("id"), "example", search_hint(F.col("template")).alias("search"))


def patterns(logs: DataFrame, q: Query, limit: int = PATTERNS_DEFAULT) -> DataFrame:
    """The most frequent templates of the newest entries; the trend compares the halves of the window."""
    middle = q.since + (q.until - q.since) // 2
    return grouped(sample(logs, q), middle).orderBy(F.col("count").desc(), "template").limit(limit)


def totals(logs: DataFrame, q: Query, limit: int = PATTERNS_DEFAULT) -> DataFrame:
    """distinct, other (entries of templates beyond the limit), truncated, since (the oldest entry seen if truncated)."""
    probe = sample(logs, q, PATTERN_ROWS + 1)
    kept = probe.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(PATTERN_ROWS)
    groups = grouped(kept, 0)
    shown = groups.orderBy(F.col("count").desc(), "template").limit(limit).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("shown"))
    whole = groups.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("all"))
    scan = probe.agg((F.count(F.lit(1)) > PATTERN_ROWS).alias("truncated"))
    oldest = kept.agg(F.min("ts").alias("oldest"))
    joined = whole.join(F.broadcast(shown), F.lit(True)).join(F.broadcast(scan), F.lit(True)).join(F.broadcast(oldest), F.lit(True))  # one row each
    return joined.select("distinct", (F.col("all") - F.col("shown")).alias("other"), "truncated", F.when(F.col("truncated"), F.col("oldest")).otherwise(F.lit(q.since)).alias("since"))


def compared(logs: DataFrame, a: Query, b: Query) -> DataFrame:
    """Templates of two windows: appeared, gone, and those whose count doubled at least."""
    one, two = (grouped(sample(logs, q), 0).select("template", F.col("count").alias(n)) for q, n in ((a, "before"), (b, "after")))
    both = one.join(two, "template", "full").na.fill(0, ["before", "after"])
    change = F.when(F.col("before") == 0, "appeared").when(F.col("after") == 0, "gone").when(F.col("after") >= 2 * F.col("before"), "more")
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def first_seen(logs: DataFrame) -> DataFrame:
    """template with the time and id of its first entry, over all entries: a new-pattern report for any window."""
    return logs.select(template(F.col("message")).alias("template"), "ts", "id").groupBy("template").agg(F.min(F.struct("ts", "id")).alias("first")).select("template", F.col("first.ts").alias("first_ts"), F.col("first.id").alias("first_id"))
