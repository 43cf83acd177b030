"""Histograms of entries over time, plain and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity_name
from ..model import BUCKETS_MAX, FIELD_KEY, GROUPS_MAX, OTHER
from ..plans.durations import auto_bucket_ms
from ..plans.query import Query, selected


def group_column(by: str) -> Column:
    """host, app, severity, or field.<key> ('' for entries without it)."""
    if by in ("host", "app"):
        return F.col(by)
    if by == "severity":
        return F.col("severity").cast("string")
    key = by.removeprefix("field.")
    if not FIELD_KEY.match(key):
        raise ValueError(f"invalid field name {key!r}")
    return F.coalesce(F.col("fields")[key], F.lit(""))


def floor_bucket(size: int) -> Column:
    return F.expr(f"ts div {int(size)} * {int(size)}")


def histogram(logs: DataFrame, q: Query, size: int, by: str | None = None) -> DataFrame:
    """bucket (its start), grp if grouped, n: only buckets with entries."""
    keys = [floor_bucket(size).alias("bucket")] + ([group_column(by).alias("grp")] if by else [])
    return selected(logs, q).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _bucket_size(q: Query, size: int | None) -> int:
    size = size or auto_bucket_ms(q.until - q.since)
    if (q.until - q.since) // size + 1 > BUCKETS_MAX:
        raise ValueError(f"more than {BUCKETS_MAX} buckets: use a larger bucket")
    return size


def assembled(logs: DataFrame, q: Query, size: int | None = None, by: str | None = None) -> DataFrame:
    """Every bucket of the range, with n = 0 where there is nothing; grouped: the ten largest groups and ``other``, where they occur.

    The range bounds the buckets and the rank bounds the groups, so what is ranked and joined here is small; the one large step is
    the partial aggregation of the histogram.
    """
    size = _bucket_size(q, size)
    first, last = q.since // size * size, q.until // size * size
    found = histogram(logs, q, size, by)
    spark = logs.sparkSession
    calendar = spark.range((last - first) // size + 1).select((F.col("id") * size + first).alias("bucket"))
    if not by:
        return calendar.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    folded = fold(found, "grp", "n")
    if by == "severity":
        folded = folded.withColumn("grp", F.coalesce(severity_name(F.col("grp").try_cast("int")), F.col("grp")))
    grouped = folded.groupBy("bucket", "grp").agg(F.sum("n").alias("n"))
    return calendar.join(grouped, "bucket", "left").select("bucket", "grp", F.coalesce("n", F.lit(0)).alias("n"))


def fold(rows: DataFrame, group: str, n: str, most: int = GROUPS_MAX) -> DataFrame:
    """Groups beyond the ``most`` largest by sum (ties by name) become ``other``."""
    top = rows.groupBy(group).agg(F.sum(n).alias("all")).orderBy(F.col("all").desc(), group).limit(most).select(F.col(group).alias("kept"))
    joined = rows.join(F.broadcast(top), F.col(group) == F.col("kept"), "left")  # at most ``most`` rows
    return joined.withColumn(group, F.when(F.col("kept").isNotNull(), F.col(group)).otherwise(OTHER)).drop("kept")
