"""Files and captured streams as lines, bodies and datagrams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.live import machine
from ..streaming.machines import Chunks, Multiline
from . import wire


#: The largest file that is read in one piece.
FILE_BYTES = 256 << 20


def tailed(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Lines of the files that appear under a path, gzipped ones too: file, line (its number), text, arrival, id. Rotated files are new
    files; the checkpoint of the query keeps the position, so that each line comes at least once.

    A file is read whole, so that lines have numbers; shippers close files well below ``FILE_BYTES``, and larger ones are an error. Ids
    are 31 bits of the file's name over 32 bits of the line's number: within a file they follow its lines, and a second reading of a
    line has the same id.
    """
    whole = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=True)
    now = F.unix_millis(F.current_timestamp())
    small = F.when(F.col("_metadata.file_size") > FILE_BYTES, F.raise_error(F.concat(F.lit("file too large to be read whole: "), F.col("_metadata.file_path")))).otherwise(F.col("value"))
    lines = whole.select(F.col("_metadata.file_path").alias("file"), now.alias("arrival"), F.posexplode(F.split(F.regexp_replace(small, r"\r?\n\z", ""), r"\r?\n")).alias("line", "text"))
    number = F.shiftleft(F.xxhash64("file").bitwiseAND(F.lit(2**31 - 1)), 32).bitwiseOR(F.col("line").cast("bigint"))
    return lines.select("file", F.col("line").cast("bigint").alias("line"), "text", "arrival", number.alias("id"))


def journal(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A followed journal as raw bodies (body, arrival, file, id) for ``decoders.decoded``: its export as JSON, an entry a line, in files."""
    rows = tailed(spark, path, per_trigger).where("text != ''")
    return rows.select(F.col("text").cast("binary").alias("body"), "arrival", "file", "id")


def events(lines: DataFrame, start: str, **limits: int) -> DataFrame:
    """A stream of numbered lines (file, line, text, arrival, id) as events of several lines."""
    return machine(lines, Multiline(start, **limits))


def _split(streams: DataFrame, split, ddl: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(peer, m, now) for peer, body, now in zip(frame["peer"], frame["body"], frame["arrival"], strict=True) for m in split(bytes(body or b""))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    return streams.select("peer", "body", "arrival").mapInPandas(run, ddl)


def syslog_lines(streams: DataFrame) -> DataFrame:
    """Captured TCP streams (peer, body, arrival) as syslog lines, counted in octets or ended by newlines."""
    return _split(streams, lambda b: wire.syslog_frames(b)[0], "peer string, line string, arrival long")


def gelf_bodies(streams: DataFrame) -> DataFrame:
    """Captured TCP streams as GELF messages, ended by NUL or newline."""
    return _split(streams, wire.gelf_frames, "peer string, body binary, arrival long")


def _chunk(datagrams: DataFrame) -> DataFrame:
    part = lambda a, n: F.hex(F.substring("body", a, n))
    number = lambda a: F.conv(part(a, 1), 16, 10).cast("int")
    return datagrams.withColumns({"key": part(3, 8), "number": number(11), "of": number(12), "data": part(13, 2**30)})


def gelf_datagrams(datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datagrams (peer, body, arrival): whole messages, and chunks to join (peer, id, number, of, data in hexadecimal, arrival)."""
    magic = F.hex(F.substring("body", 1, 2)) == "1E0F"
    chunks = _chunk(datagrams.where(magic & (F.octet_length("body") > 12)))
    return datagrams.where(~magic), chunks.select("peer", F.col("key").alias("id"), "number", "of", "data", "arrival")


def joined_chunks(chunks: DataFrame, live: bool = False) -> DataFrame:
    """Whole messages (peer, body, arrival) of chunks, within five seconds of the first."""
    from ..streaming.batch import fold

    made = machine(chunks, Chunks()) if live else fold(chunks, Chunks())
    return made.select("peer", F.unhex("data").alias("body"), "arrival")
