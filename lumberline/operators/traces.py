"""Traces: first copies of spans, lists with conditions, roots, and what a reader may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TRACES_DEFAULT
from ..plans.query import Access


def first_spans(spans: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row of each (trace_id, span_id): the first by arrival, or else the least row."""
    others = [c for c in spans.columns if c not in ("trace_id", "span_id", arrival)]
    spans = spans.repartition("trace_id")  # whatever groups by trace next needs no other exchange
    row = F.struct(*others)
    best = F.min(row) if arrival is None else F.min_by(row, F.struct(arrival, *others))
    return spans.groupBy("trace_id", "span_id").agg(best.alias("row")).select("trace_id", "span_id", "row.*").select(*[c for c in spans.columns if c != arrival])


def in_window(spans: DataFrame, since: int, until: int) -> DataFrame:
    """All copies of the spans of traces that have one in the window (ms): the scan behind the choice of traces sees the window."""
    chosen = spans.where(F.col("start_us").between(since * 1000, until * 1000 + 999)).select("trace_id").distinct()
    return spans.join(chosen, "trace_id", "left_semi")


def roots(spans: DataFrame) -> DataFrame:
    """trace_id with name and service of its root: a span without parent, else the earliest; ties by span_id."""
    order = F.struct(F.when(F.col("parent_id") == "", 0).otherwise(1), "start_us", "span_id")
    return spans.groupBy("trace_id").agg(F.min_by(F.struct("name", "service"), order).alias("root")).select("trace_id", F.col("root.name").alias("root_name"), F.col("root.service").alias("root_service"))


def listed(
    spans: DataFrame,
    since: int,
    until: int,
    service: str | None = None,
    host: str | None = None,
    name: str | None = None,
    min_us: int | None = None,
    errors: bool = False,
    access: Access | None = None,
    limit: int = TRACES_DEFAULT,
) -> DataFrame:
    """Traces with spans that start in the window (ms), newest first: start_ms, duration_us, spans, errors, services, hosts, root.

    Conditions hold if any span of the trace in the window meets them. One aggregation gives the page; the root comes from all
    spans of the page's traces, by a semi-join with the page before they are grouped.
    """
    inside = spans.where(F.col("start_us").between(since * 1000, until * 1000 + 999))
    pairs = F.collect_set(F.struct("host", "service"))
    found = inside.groupBy("trace_id").agg(
        F.min("start_us").alias("start_us"),
        (F.max(F.col("start_us") + F.col("duration_us")) - F.min("start_us")).alias("duration_us"),
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("status") == 2).alias("errors"),
        F.array_remove(F.sort_array(F.collect_set("service")), "").alias("services"),
        F.array_remove(F.sort_array(F.collect_set("host")), "").alias("hosts"),
        *([F.bool_or(F.col("service") == service).alias("_service")] if service else []),
        *([F.bool_or(F.col("host") == host).alias("_host")] if host else []),
        *([F.bool_or(F.lower("name").contains(name.lower())).alias("_name")] if name else []),
        *([F.bool_or(F.col("duration_us") >= min_us).alias("_long")] if min_us else []),
        *([pairs.alias("_pairs")] if access else []),
    )
    wanted = [F.col(c) for c in found.columns if c in ("_service", "_host", "_name", "_long")]
    if errors:
        wanted.append(F.col("errors") > 0)
    if access:
        wanted.append(F.forall("_pairs", lambda p: access.predicate(p["host"], p["service"])))
    page = found.where(reduce(lambda a, b: a & b, wanted, F.lit(True))).orderBy(F.col("start_us").desc(), "trace_id").limit(limit)
    page = page.select("trace_id", F.floor(F.col("start_us") / 1000).cast("bigint").alias("start_ms"), "duration_us", "spans", "errors", "services", "hosts", "start_us")
    ends = roots(spans.join(page.select("trace_id"), "trace_id", "left_semi"))
    return page.join(ends, "trace_id").orderBy(F.col("start_us").desc(), "trace_id").drop("start_us")


def detail(spans: DataFrame, trace_id: str, access: Access | None = None, limit: int = 10_000) -> DataFrame:
    """The spans of a trace that a reader may see, in order of start."""
    own = spans.where(F.col("trace_id") == trace_id)
    if access:
        own = own.where(access.predicate(F.col("host"), F.col("service")))
    return own.orderBy("start_us", "span_id").limit(limit)
