"""Machines over stored history: rows are dealt by key and sorted by arrival, and each task folds its keys as rows stream by.

Only the state of the current key is held, however many rows a key has. The fold of one key is sequential by nature; whatever can
be decided without order (scopes, patterns, counts per window) is filtered or aggregated before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import template
from .machines import Machine, PerMinute, Volume, Watch


def fold(rows: DataFrame, machine: Machine, until: int | None = None) -> DataFrame:
    """The machine's outputs over rows (its keys and columns, arrival, and id to break ties); until: ticks up to then, none given: none."""
    names = list(dict.fromkeys((*machine.keys, *machine.columns, "arrival", "id")))
    columns = [c.split()[0] for c in machine.schema.split(", ")]
    keys = list(machine.keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, seen = None, None, False

        def ticks(state, now):
            out = []
            while state is not None and (at := machine.due(state)) is not None and at <= now:
                new, told = machine.tick(state, at)
                out += told
                if new == state:
                    break
                state = new
            return state, out

        for frame in frames:
            out = []
            for row in frame.astype(object).to_dict("records"):
                key = tuple(row[k] for k in keys)
                if not seen or key != current:
                    if seen and until is not None:
                        out += ticks(state, until)[1]
                    state, current, seen = None, key, True
                state, told = ticks(state, row["arrival"])
                out += told
                state, told = machine.step(state, row)
                out += told
            if out:
                yield pd.DataFrame(out, columns=columns)
        if seen and until is not None and (out := ticks(state, until)[1]):
            yield pd.DataFrame(out, columns=columns)

    dealt = rows.select(*names)
    dealt = dealt.repartition(*keys) if keys else dealt.repartition(1)
    return dealt.sortWithinPartitions(*keys, "arrival", "id").mapInPandas(run, machine.schema)


def window_counts(logs: DataFrame, size: int) -> DataFrame:
    """host, number and n of every window from the first to the last of all entries, zeros included."""
    at = F.floor(F.col("arrival") / size).cast("bigint")
    found = logs.groupBy("host", at.alias("number")).agg(F.count(F.lit(1)).alias("n"))
    last = found.agg(F.max("number").alias("last"))
    hosts = found.groupBy("host").agg(F.min("number").alias("first")).join(F.broadcast(last), F.lit(True))  # one row
    every = hosts.select("host", F.explode(F.sequence("first", "last")).alias("number"))
    return every.join(found, ["host", "number"], "left").na.fill(0, ["n"])


def volume(logs: DataFrame, machine: Volume) -> DataFrame:
    """Surges and drops; the rows folded are windows, not entries."""
    counts = window_counts(logs, machine.window).withColumns({"arrival": F.col("number"), "id": F.col("number")})
    return fold(counts, machine)


def volume_by_expression(logs: DataFrame, machine: Volume) -> DataFrame:
    """The same as one higher-order fold over each host's ordered windows, without Python."""
    m = machine
    counts = window_counts(logs, m.window).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("c"))  # windows of a host
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0).alias("seen"), F.lit(0).alias("odd"), F.lit(None).cast("bigint").alias("fired"), F.array().cast("array<struct<ts:bigint,kind:string,n:bigint,baseline:bigint>>").alias("out"))

    def step(s, x):
        n, now = x["n"], (x["number"] + 1) * m.window
        ready = (s["seen"] >= m.windows) & (s["b"] >= m.least)
        surge = ready & (n >= m.high * s["b"]) if m.high > 0 else F.lit(False)
        drop = ready & (n <= m.low * s["b"]) if m.low > 0 else F.lit(False)
        fires = (surge | drop) & (s["fired"].isNull() | (now - s["fired"] >= m.cooldown))
        odd = F.when(surge | drop, s["odd"] + 1).otherwise(0)
        folds = (odd == 0) | (odd >= m.windows)
        alpha = F.when(s["seen"] == 0, 1.0).when(s["seen"] < m.windows, 1 / (s["seen"] + 1)).otherwise(2 / (m.windows + 1))
        event = F.struct(now.alias("ts"), F.when(surge, "surge").otherwise("drop").alias("kind"), n.alias("n"), F.floor(s["b"] + 0.5).cast("bigint").alias("baseline"))
        return F.struct(
            F.when(folds, (1 - alpha) * s["b"] + alpha * n).otherwise(s["b"]).alias("b"),
            F.when(folds, s["seen"] + 1).otherwise(s["seen"]).alias("seen"),
            odd.alias("odd"),
            F.when(fires, now).otherwise(s["fired"]).alias("fired"),
            F.when(fires, F.concat(s["out"], F.array(event))).otherwise(s["out"]).alias("out"),
        )

    found = counts.select("host", F.explode(F.aggregate("c", start, step, lambda s: s["out"])).alias("e"))
    return found.select("e.ts", "e.kind", "host", "e.n", "e.baseline")


def watch(logs: DataFrame, machine: Watch, severities: list[int] | None = None, ignore: list[str] | None = None, per_minute: int | None = None) -> DataFrame:
    """Notices of new templates and surges."""
    from ..functions.regexes import matches

    rows = logs.where(F.col("severity").isin(*(severities or range(5))))
    for pattern in ignore or []:
        rows = rows.where(~matches(F.col("message"), pattern))
    rows = rows.withColumn("template", template(F.col("message"))).where("template != ''")
    found = fold(rows, machine)
    if per_minute is None:
        return found
    return fold(found.withColumns({"arrival": F.col("ts"), "id": F.xxhash64("template")}), PerMinute(per_minute))


def joined_lines(lines: DataFrame, start: str, most: int = 500) -> DataFrame:
    """Events of files (file, line, text) where only ``start`` and ``most`` end them: runs by a running count, without state."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("line")
    begins = F.col("text").rlike(start).cast("int")
    runs = lines.withColumn("run", F.sum(begins).over(order))
    place = F.row_number().over(Window.partitionBy("file", "run").orderBy("line")) - 1
    runs = runs.withColumn("part", F.floor(place / most))
    packed = runs.groupBy("file", "run", "part").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    return packed.select("file", "line", "lines", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
