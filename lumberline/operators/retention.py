"""What stays: rules and ages, the size cap, and spans' own cutoff."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, globs


@dataclass
class Rule:
    """Entries in scope go if older than cutoff; None keeps them for good."""

    hosts: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)
    severities: list[int] = field(default_factory=list)
    cutoff: int | None = None

    def scope(self) -> Column:
        found = F.lit(True)
        if self.hosts:
            found = found & globs(F.col("host"), self.hosts)
        if self.apps:
            found = found & globs(F.col("app"), self.apps)
        return found & F.col("severity").isin(*self.severities) if self.severities else found


def keeps(rules: list[Rule], by_severity: dict[int, int]) -> Column:
    """Whether an entry stays: the first rule in whose scope it is decides, else the cutoff of its severity, if there is one."""
    kept = F.lit(True)
    for severity, cutoff in by_severity.items():
        kept = F.when(F.col("severity") == severity, F.col("ts") >= cutoff).otherwise(kept)
    for rule in reversed(rules):
        kept = F.when(rule.scope(), F.lit(True) if rule.cutoff is None else F.col("ts") >= rule.cutoff).otherwise(kept)
    return kept


def split(logs: DataFrame, rules: list[Rule], by_severity: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Entries that stay, and entries to archive and drop; one narrow pass, day partitions prune by the least cutoff."""
    kept = F.coalesce(keeps(rules, by_severity), F.lit(True))
    return logs.where(kept), logs.where(~kept)


def spans_cutoff(by_severity: dict[int, int]) -> int | None:
    """Spans go by the earliest cutoff, if all severities have one."""
    return min(by_severity.values()) if len(by_severity) == 8 else None


def size_of(row: str = "") -> Column:
    """Bytes of an entry's text and fixed columns."""
    text = (F.octet_length(F.coalesce(c, F.lit(""))) for c in (F.col("host"), F.col("app"), F.col("message"), canonical_json(F.col("fields"))))
    return sum(text, F.lit(20)).cast("bigint")


def within_size(logs: DataFrame, cap: int, share: float = 0.9, chunk: int = 3_600_000) -> DataFrame:
    """The newest entries that fit in ``share`` of the cap, if all don't fit in the cap.

    Sizes are first summed per chunk of time; only the chunk in which the limit falls is ordered entry by entry, so that no task
    holds the whole table.
    """
    at = F.floor(F.col("ts") / chunk).cast("bigint")
    sized = logs.withColumn("_size", size_of()).withColumn("_chunk", at)
    chunks = sized.groupBy("_chunk").agg(F.sum("_size").alias("bytes"))
    newer = F.sum("bytes").over(Window.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("bytes").over(Window.partitionBy())
    placed = chunks.select("_chunk", F.coalesce(newer, F.lit(0)).alias("_newer"), total.alias("_total"), "bytes")  # a row for each hour
    joined = sized.join(placed, "_chunk")
    limit = F.lit(int(cap * share))
    order = Window.partitionBy("_chunk").orderBy(F.col("ts").desc(), F.col("id").desc())
    whole = joined.where((F.col("_total") <= cap) | (F.col("_newer") + F.col("bytes") <= limit))
    edge = joined.where((F.col("_total") > cap) & (F.col("_newer") <= limit) & (F.col("_newer") + F.col("bytes") > limit))
    fits = edge.withColumn("_run", F.sum("_size").over(order) + F.col("_newer")).where(F.col("_run") <= limit)
    return whole.select(*logs.columns).unionByName(fits.select(*logs.columns))
