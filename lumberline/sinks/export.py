"""Rows as NDJSON, CSV, terminal lines and RFC 5424 messages; archives by day, backups and restores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, severity_name, truncated
from ..model import ENTRY, LOGS

CSV_HEADER = "id,ts,time,host,app,severity,message,fields"
SD_ID, SD_FIELDS, SD_VALUE, SYSLOG_BYTES = "fields@32473", 32, 256, 8192  # 32473: the number for examples


def iso_time(ts: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ndjson(with_id: bool = True) -> Column:
    """An entry as JSON; no fields, no key for them."""
    sorted_fields = F.when(F.size("fields") > 0, F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    columns = (["id"] if with_id else []) + ["ts", "host", "app", "severity", "message"]
    return F.to_json(F.struct(*columns, sorted_fields.alias("fields")), {"ignoreNullFields": "true"})


def csv_line() -> Column:
    cells = [F.col("id").cast("string"), F.col("ts").cast("string"), iso_time(F.col("ts")), F.col("host"), F.col("app"), F.col("severity").cast("string"), F.col("message"), canonical_json(F.col("fields"))]
    quoted = (F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(c, F.lit("")) for c in cells))
    return F.concat_ws(",", *quoted)


def terminal_line(with_fields: bool = True) -> Column:
    app = F.when(F.col("app") == "", "-").otherwise(F.coalesce("app", F.lit("-")))
    line = F.concat_ws(" ", iso_time(F.col("ts")), F.coalesce("host", F.lit("?")), app, severity_name(F.least(F.col("severity"), F.lit(7))), F.replace("message", F.lit("\n"), F.lit("\n    ")))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return F.when(F.size("fields") > 0, F.concat(line, F.lit("  {"), pairs, F.lit("}"))).otherwise(line) if with_fields else line


def _token(text: Column, most: int) -> Column:
    clean = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[^!-~]", "_"), 1, most)
    return F.when(clean == "", "-").otherwise(clean)


def rfc5424() -> Column:
    """An entry as a syslog message of facility user, its fields as one element of structured data."""
    value = lambda v: F.regexp_replace(F.regexp_replace(F.substring(v, 1, SD_VALUE), r"([\\\"\]])", r"\\$1"), r"\p{Cc}", " ")
    short = F.slice(F.filter(F.array_sort(F.map_entries("fields")), lambda e: F.octet_length(e["key"]) <= 32), 1, SD_FIELDS)
    pairs = F.array_join(F.transform(short, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), value(e["value"]), F.lit('"'))), "")
    data = F.when(F.coalesce(pairs, F.lit("")) == "", "-").otherwise(F.concat(F.lit(f"[{SD_ID}"), pairs, F.lit("]")))
    head = F.concat(F.lit("<"), (8 + F.least("severity", F.lit(7))).cast("string"), F.lit(">1 "))
    return F.concat(head, F.concat_ws(" ", iso_time(F.col("ts")), _token(F.col("host"), 255), _token(F.col("app"), 48), F.lit("- -"), data, truncated(F.col("message"), SYSLOG_BYTES)))


def octet_frame(message: Column) -> Column:
    return F.concat(F.octet_length(message).cast("string"), F.lit(" "), message)


def write_export(rows: DataFrame, path: str, form: str = "ndjson") -> None:
    """Part files in (ts, id) order; CSV files begin with the header and end lines with CRLF."""
    ordered = rows.orderBy("ts", "id")
    if form == "ndjson":
        ordered.select(ndjson().alias("value")).write.text(path)
    elif form == "csv":
        ordered.select(csv_line().alias(CSV_HEADER)).write.option("lineSep", "\r\n").text(path)
    else:
        raise ValueError(f"unknown format {form!r}")


def write_archive(rows: DataFrame, path: str) -> None:
    """Entries as gzipped NDJSON by year, month and day, in order within files; what is archived is dropped only after this."""
    at = F.timestamp_millis("ts")
    parts = rows.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")})
    lines = parts.select(ndjson(with_id=False).alias("value"), "year", "month", "day", "ts", "id")
    dealt = lines.repartition("year", "month", "day").sortWithinPartitions("year", "month", "day", "ts", "id")
    dealt.select("value", "year", "month", "day").write.mode("append").partitionBy("year", "month", "day").option("compression", "gzip").text(path)


def read_archive(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Entries of archived days (YYYY-MM-DD, inclusive); partitions outside stay unread."""
    rows = spark.read.option("basePath", path).schema("value string, year string, month string, day string").text(path)
    day = F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
    if first_day:
        rows = rows.where(day >= first_day)
    if last_day:
        rows = rows.where(day <= last_day)
    return rows.select(F.from_json("value", ENTRY).alias("e")).where("e.message is not null").select("e.*")


def backup(logs: DataFrame, path: str) -> dict[str, int]:
    """A copy whose row count and checksum agree with the source; raises if not."""
    logs.select(*LOGS.fieldNames()).write.parquet(path)
    seen = [_checksum(df) for df in (logs, logs.sparkSession.read.schema(LOGS).parquet(path))]
    if seen[0] != seen[1]:
        raise OSError(f"backup differs from its source: {seen[1]} against {seen[0]}")
    return seen[0]


def _checksum(df: DataFrame) -> dict[str, int]:
    row = F.xxhash64("id", "ts", "host", "app", "severity", "message", canonical_json(F.col("fields")))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.pmod(row, F.lit(2**31))), F.lit(0)).alias("sum")).first().asDict()


def oldest_backups(names: list[str], keep: int) -> list[str]:
    """Names (which sort by time) to remove so that the newest stay."""
    return sorted(names)[: max(0, len(names) - keep)]
