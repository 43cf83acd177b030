"""Searches: newest or oldest entries, pages by cursor, an entry's neighbours, the newest samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONTEXT_DEFAULT
from ..plans.query import Access, Query, _with, selected


def search(logs: DataFrame, q: Query, oldest_first: bool = False) -> DataFrame:
    """The first ``limit`` entries in the order (ts, id), newest first unless told otherwise; a top-k, never a full sort."""
    order = [F.col("ts"), F.col("id")] if oldest_first else [F.col("ts").desc(), F.col("id").desc()]
    return selected(logs, q).orderBy(*order).limit(q.limit)


def page(logs: DataFrame, q: Query) -> tuple[DataFrame, str | None]:
    """A page and the cursor of the next one, if this one is full. Collects the page's last row alone."""
    found = search(logs, q)
    last = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("last")).first()
    return found, f"{last['last']['ts']}:{last['last']['id']}" if last["n"] == q.limit else None


def next_page(q: Query, ts: int, row: int) -> Query:
    return _with(q, cursor=(ts, row))


def context(logs: DataFrame, row_id: int, lines: int = CONTEXT_DEFAULT, same_host: bool = True, access: Access | None = None) -> DataFrame:
    """The entries before and after one, oldest first, with its side in ``side`` (before, after). Empty for an unknown or hidden one.

    The entry itself is one row, broadcast for its neighbours to compare with; either side is a top-k.
    """
    seen = logs.where((access or Access()).predicate(F.col("host"), F.col("app")))
    here = F.broadcast(seen.where(F.col("id") == row_id).limit(1).select(F.struct("ts", "id").alias("at"), F.col("host").alias("at_host")))  # one row
    near = seen.join(here, F.col("host") == F.col("at_host") if same_host else F.lit(True))
    at = F.struct("ts", "id")
    before = near.where((at < F.col("at")) & (F.col("ts") <= F.col("at.ts"))).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(lines)
    after = near.where((at > F.col("at")) & (F.col("ts") >= F.col("at.ts"))).orderBy("ts", "id").limit(lines)
    both = before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))
    return both.drop("at", "at_host").orderBy("ts", "id")


def newest(logs: DataFrame, q: Query, n: int) -> DataFrame:
    return search(logs, _with(q, limit=n))


def newest_per(logs: DataFrame, key: str, n: int) -> DataFrame:
    """The n newest entries of each key, by rank; partial top-k per task keeps a hot key from gathering whole."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc()))
    return logs.withColumn("rank", rank).where(F.col("rank") <= n)


def exported(logs: DataFrame, q: Query, cap: int | None = None) -> DataFrame:
    """All entries of a query, oldest first."""
    found = selected(logs, q).orderBy("ts", "id")
    return found.limit(cap) if cap else found


def truncated_flag(found: DataFrame, limit: int) -> tuple[DataFrame, Column]:
    """Probe with one row more than the limit: the rows within it, and whether there was one more."""
    return found.limit(limit), F.lit(found.limit(limit + 1).count() > limit)
