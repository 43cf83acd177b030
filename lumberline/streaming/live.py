"""Machines, tails and writers on Structured Streaming."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsers import applied as parsers_applied
from ..functions.rules import applied as rules_applied
from ..functions.scalars import truncated
from ..functions.structured import enriched
from ..functions.traces import with_trace_ids
from ..model import MESSAGE_BYTES, METRIC_SERIES, NAME_BYTES
from ..plans.query import Query, predicate
from ..sources import cef
from .machines import Machine, packed, unpacked


def machine(stream: DataFrame, m: Machine, clock: Callable[[], int] | None = None) -> DataFrame:
    """A machine over a stream (its keys and columns, arrival, id): rows of a micro-batch are stepped in the order of arrival.

    Ticks come from processing-time timers, whose clock is the batch's; state is JSON in the state store.
    """
    columns = [c.split()[0] for c in m.schema.split(", ")]
    names = list(dict.fromkeys((*m.keys, *m.columns, "arrival", "id")))
    keys = list(m.keys) or ["_all"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = unpacked(state.get[0]) if state.exists else None, []
        now = clock() if clock else int(time.time() * 1000)
        if state.hasTimedOut:
            held, out = m.tick(held, now)
        else:
            rows = pd.concat(list(frames)).sort_values(["arrival", "id"], kind="stable")
            for row in rows.astype(object).to_dict("records"):
                while held is not None and (at := m.due(held)) is not None and at <= row["arrival"]:
                    new, told = m.tick(held, at)
                    out += told
                    if new == held:
                        break
                    held = new
                held, told = m.step(held, row)
                out += told
        if held is None:
            state.remove()
        else:
            state.update((packed(held),))
            if (at := m.due(held)) is not None:
                state.setTimeoutDuration(max(1, at - now))
        yield pd.DataFrame(out, columns=columns)

    rows = stream.select(*names) if m.keys else stream.select(*names).withColumn("_all", F.lit(0))
    return rows.groupBy(*keys).applyInPandasWithState(run, m.schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tail(stream: DataFrame, q: Query) -> DataFrame:
    """Accepted entries that match, by the predicate of searches with free text as substrings."""
    return stream.where(predicate(q, live=True))


def named(stream: DataFrame) -> DataFrame:
    """Host and app cut to the bytes that names may have: what silence, volume and rate limits read."""
    return stream.withColumns({c: truncated(F.col(c), NAME_BYTES) for c in ("host", "app")})


def pipeline(stream: DataFrame, rules: list | None = None, structured: bool = True, parsers: list | None = None, cef_records: bool = True) -> DataFrame:
    """The stateless stages of ingestion up to where alerts read, in their order: names cut, CEF, parsers, and generic fields where no
    parser stands in for them, trace ids, rules.

    Silence, volume and rate limits read ``named`` (limits after the other two); log metrics, alerts and watches read what this
    returns; runs of repeats (``Dedup``) come next, and ``ready`` makes what is stored, forwarded and tailed.
    """
    stream = named(stream)
    if cef_records:
        stream = cef.enriched(stream)
    if parsers:
        stream = parsers_applied(stream, parsers, structured)
    elif structured:
        stream = stream.withColumn("fields", enriched(F.col("message"), F.col("fields")))
    stream = stream.withColumn("fields", with_trace_ids(F.col("fields")))
    return rules_applied(stream, rules or [])


def ready(stream: DataFrame, message_bytes: int = MESSAGE_BYTES) -> DataFrame:
    """Entries as they are stored: messages cut, and names again, which a parser or a rule may have set."""
    return named(stream).withColumn("message", truncated(F.col("message"), message_bytes))


def _put_once(batch: DataFrame, number: int, path: str, checkpoint: str, *by: str) -> None:
    """Appends a micro-batch under a partition of its own (``_batch``: a hash of the query's checkpoint, and the batch's number), which a
    replay replaces: a batch that was written in full or in part before a failure is there once."""
    name = f"{zlib.crc32(checkpoint.encode()):08x}-{number}"
    made = batch.withColumn("_batch", F.lit(name))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", *by).parquet(path)


def written(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends entries to Parquet by micro-batch and UTC day, sorted by (ts, id) within files; a replayed batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        day = F.to_date(F.timestamp_millis("ts"))
        _put_once(batch.withColumn("day", day).sortWithinPartitions("day", "ts", "id"), number, path, checkpoint, "day")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()


def spans_written(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends spans that are not there yet; the first of a (trace_id, span_id) stays: by ``arrival`` if there is such a column, else the
    least row of its batch. A replayed batch replaces itself, and doesn't count as known."""

    def put(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        others = [c for c in batch.columns if c not in ("trace_id", "span_id", "arrival")]
        order = F.struct(*(c for c in ("arrival", *others) if c in batch.columns))
        new = batch.groupBy("trace_id", "span_id").agg(F.min_by(F.struct(*(c for c in batch.columns if c not in ("trace_id", "span_id"))), order).alias("row")).select("trace_id", "span_id", "row.*") if len(batch.columns) > 2 else batch.distinct()
        own = f"{zlib.crc32(checkpoint.encode()):08x}-{number}"
        try:
            known = batch.sparkSession.read.parquet(path).where(F.col("_batch") != own).select("trace_id", "span_id")
            new = new.join(known, ["trace_id", "span_id"], "left_anti").select(*batch.columns)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        _put_once(new, number, path, checkpoint)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reloading(stream: DataFrame, load: Callable[[], dict], act: Callable[[DataFrame, dict], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is acted on with the settings as they are then."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: act(batch, load())).start()


def counted(stream: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    """Running counts and sums per label tuple, for update or complete mode; ``first`` is the arrival that capped needs, if there is one."""
    sums = [F.sum(F.col(value)).alias("sum")] if value else []
    first = [F.min("arrival").alias("first")] if "arrival" in stream.columns else []
    return stream.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"), *sums, *first)


def capped(totals: DataFrame, labels: list[str], most: int = METRIC_SERIES) -> DataFrame:
    """A complete-mode result of ``counted`` with the label tuples beyond the first ``most`` to arrive folded into ``_other``."""
    held = totals.orderBy("first", *labels).limit(most).select(*(F.col(c).alias(f"_{c}") for c in labels))
    joined = totals.join(F.broadcast(held), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in labels] + [F.lit(True)], "left").withColumn("_known", F.col(f"_{labels[0]}").isNotNull())  # at most ``most`` rows
    sums = [F.sum(c).alias(c) for c in ("count", "sum") if c in totals.columns]
    return joined.select(*(F.when(F.col("_known"), F.col(c)).otherwise("_other").alias(c) for c in labels), *(c for c in ("count", "sum") if c in totals.columns)).groupBy(*labels).agg(*sums)
