"""Per-host answers: summary, form over a window, windows before now, storage, known hosts, and states for a board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Query, selected

SORTS = ("count", "errors", "warnings", "last_ts", "host")


def summary(logs: DataFrame, q: Query, sort: str = "count", descending: bool = True, limit: int | None = None) -> DataFrame:
    """host, count, errors (severity 3 or worse), warnings, last_ts."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    found = selected(logs, q).groupBy("host").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") <= 3).alias("errors"), F.count_if(F.col("severity") == 4).alias("warnings"), F.max("ts").alias("last_ts"))
    order = F.col(sort).desc() if descending else F.col(sort)
    found = found.orderBy(order, "host")
    return found.limit(limit) if limit else found


def form(logs: DataFrame, q: Query, slices: int) -> DataFrame:
    """host, slice, count, errors, warnings for all slices of [since, until] of every host that has entries in it."""
    slices, span = max(1, slices), max(1, q.until - q.since)
    at = F.least(F.lit(slices - 1), F.greatest(F.lit(0), F.floor((F.col("ts") - q.since) * slices / span).cast("int")))
    found = selected(logs, q).groupBy("host", at.alias("slice")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") <= 3).alias("errors"), F.count_if(F.col("severity") == 4).alias("warnings"))
    every = found.select("host").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return every.join(found, ["host", "slice"], "left").na.fill(0, ["count", "errors", "warnings"])


def window_counts(logs: DataFrame, now: int, window: int, windows: int) -> DataFrame:
    """host, window (0 the oldest), n: complete windows before now, aligned to the epoch, zeros included."""
    last = now // window
    first = last - windows
    found = logs.where((F.col("ts") >= first * window) & (F.col("ts") < last * window)).groupBy("host", (F.floor(F.col("ts") / window) - first).cast("int").alias("window")).agg(F.count(F.lit(1)).alias("n"))
    every = found.select("host").distinct().withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    return every.join(found, ["host", "window"], "left").na.fill(0, ["n"])


def storage(logs: DataFrame, now: int) -> DataFrame:
    """entries, oldest, newest, last_day."""
    return logs.agg(F.count(F.lit(1)).alias("entries"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count_if(F.col("ts") > now - 86_400_000).alias("last_day"))


def known(logs: DataFrame, limit: int) -> DataFrame:
    return logs.select("host").distinct().orderBy("host").limit(limit)


def board(logs: DataFrame, q: Query, now: int, silent_after: int, failing: int = 10, degraded: int = 1) -> DataFrame:
    """host, state (silent, failing, degraded, healthy), rank (worst first) and the summary."""
    rows = summary(logs, q)
    state = F.when(F.lit(now) - F.col("last_ts") > silent_after, "silent").when(F.col("errors") >= failing, "failing").when((F.col("errors") >= degraded) | (F.col("warnings") >= failing), "degraded").otherwise("healthy")
    ranks = {"silent": 0, "failing": 1, "degraded": 2, "healthy": 3}
    rows = rows.withColumn("state", state)
    return rows.withColumn("rank", F.create_map(*(F.lit(x) for p in ranks.items() for x in p))[F.col("state")]).orderBy("rank", F.col("errors").desc(), "host")


def compared(logs: DataFrame, a: Query, b: Query) -> DataFrame:
    """host with its counts in two windows, and the difference."""
    one, two = (selected(logs, q).groupBy("host").agg(F.count(F.lit(1)).alias(n), F.count_if(F.col("severity") <= 3).alias(f"{n}_errors")) for q, n in ((a, "before"), (b, "after")))
    return one.join(two, "host", "full").na.fill(0).withColumn("change", F.col("after") - F.col("before"))
