"""Top values of a column or field, their totals, and the fields that occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FIELDS_DEFAULT, TOP_DEFAULT
from ..plans.query import Query, selected
from .stats import group_column


def _values(logs: DataFrame, q: Query, by: str) -> DataFrame:
    return selected(logs, q).groupBy(group_column(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top(logs: DataFrame, q: Query, by: str, limit: int = TOP_DEFAULT) -> DataFrame:
    """value and n, the most frequent first, ties by value; empty values stay out."""
    return _values(logs, q, by).where("value != ''").orderBy(F.col("n").desc(), "value").limit(limit)


def totals(logs: DataFrame, q: Query, by: str, limit: int = TOP_DEFAULT) -> DataFrame:
    """matching, with_field, distinct, other (entries with a value beyond the limit); counts are exact, from one pass."""
    values = _values(logs, q, by)
    shown = values.where("value != ''").orderBy(F.col("n").desc(), "value").limit(limit).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"))
    present = F.col("value") != ""
    whole = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matching"), F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("with_field"), F.count_if(present).alias("distinct"))
    return whole.join(F.broadcast(shown), F.lit(True)).select("matching", "with_field", "distinct", (F.col("with_field") - F.col("shown")).alias("other"))  # one row each


def field_names(logs: DataFrame, q: Query, limit: int = FIELDS_DEFAULT) -> DataFrame:
    """key and n, the most frequent first, ties by key."""
    keys = selected(logs, q).select(F.explode(F.map_keys("fields")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key").limit(limit)
