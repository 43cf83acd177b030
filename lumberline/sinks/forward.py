"""Forwards and notifications: batches to HTTP receivers with one retry table, e-mail with an hourly cap, counters as text."""

from __future__ import annotations

import smtplib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.regexes import matches
from ..functions.scalars import globs
from .export import ndjson

BATCH = 200
RETRIED = frozenset({408, 425, 429, *range(500, 600)})


def wanted(entries: DataFrame, hosts: list[str] | None = None, apps: list[str] | None = None, severities: list[int] | None = None, pattern: str | None = None) -> DataFrame:
    if hosts:
        entries = entries.where(globs(F.col("host"), hosts))
    if apps:
        entries = entries.where(globs(F.col("app"), apps))
    if severities:
        entries = entries.where(F.col("severity").isin(*severities))
    return entries.where(matches(F.col("message"), pattern)) if pattern else entries


def post(url: str, body: bytes, headers: dict[str, str], timeout: float = 10.0) -> int:
    request = urllib.request.Request(url, body, headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 599


def delivered(send: Callable[[], int], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> bool:
    """Whether a batch arrived: refusals that may pass are tried again with growing pauses, others are dropped."""
    for i in range(tries):
        status = send()
        if status < 300:
            return True
        if status not in RETRIED:
            return False
        if i + 1 < tries:
            wait(min(30.0, 2.0**i))
    return False


def sent(lines: DataFrame, url: str, headers: dict[str, str] | None = None, size: int = BATCH, send: Callable[[str, bytes, dict[str, str]], int] = post) -> DataFrame:
    """Sends lines (value) from where they are, ``size`` a request; one row for each request: lines, ok."""
    head = {"Content-Type": "application/x-ndjson"} | (headers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in range(0, len(frame), size):
                part = frame["value"].iloc[i : i + size]
                body = "".join(f"{x}\n" for x in part).encode()
                out.append((len(part), delivered(lambda body=body: send(url, body, head))))
            yield pd.DataFrame(out, columns=["lines", "ok"])

    return lines.mapInPandas(run, "lines long, ok boolean")


def forwarded(stream: DataFrame, url: str, checkpoint: str, headers: dict[str, str] | None = None, **filters) -> StreamingQuery:
    """A stream's entries as NDJSON to a receiver, a micro-batch a second."""

    def put(batch: DataFrame, _: int) -> None:
        sent(wanted(batch, **filters).select(ndjson(with_id=False).alias("value")), url, headers).write.format("noop").mode("overwrite").save()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="1 second").foreachBatch(put).start()


class Mailer:
    """Notifications by e-mail: of the wanted kinds, so many an hour."""

    def __init__(self, host: str, port: int, sender: str, to: list[str], per_hour: int = 20, kinds: list[str] | None = None, connect: Callable = smtplib.SMTP):
        self.host, self.port, self.sender, self.to, self.per_hour, self.kinds, self.connect = host, port, sender, to, per_hour, kinds, connect
        self.hour, self.count = -1, 0

    def send(self, kind: str, subject: str, text: str, now: int) -> bool | None:
        """None if not wanted or over the cap."""
        if self.kinds is not None and kind not in self.kinds:
            return None
        if now // 3_600_000 != self.hour:
            self.hour, self.count = now // 3_600_000, 0
        if self.count >= self.per_hour:
            return None
        self.count += 1
        mail = EmailMessage()
        mail["From"], mail["To"], mail["Subject"] = self.sender, ", ".join(self.to), " ".join(subject.split())
        mail.set_content(text)
        try:
            with self.connect(self.host, self.port) as server:
                server.send_message(mail)
        except OSError:
            return False
        return True


def prometheus(rows: DataFrame, name: str, help_text: str, labels: list[str], kind: str = "counter", value: str = "count") -> DataFrame:
    """Counters (labels and a value) as exposition text: one row with the lines in order."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 128), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels))
    line = F.concat(F.lit(name), F.concat(F.lit("{"), pairs, F.lit("}")) if labels else F.lit(""), F.lit(" "), F.col(value).cast("string"))
    lines = rows.select(line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))  # as many as the series cap
    return lines.select(F.concat(F.lit(f"# HELP {name} {help_text}\n# TYPE {name} {kind}\n"), F.col("lines"), F.lit("\n")).alias("text"))
