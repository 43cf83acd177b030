"""Queries of decoders, enrichment and renderings: the events table written in each format and read back, and lines as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import logs, spans
from ..catalog import audit_wanted
from ..functions import messages, parsers
from ..functions.structured import enriched
from ..functions.traces import with_trace_ids
from ..operators import traces
from ..sinks import export, forward
from ..sources import cef, decoders, syslog
from ..streaming import batch
from .registry import LEVEL, NAMES, T0, _logs, _spans, query

PLAIN = "ts, host, app, severity, message"
ISO = "strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts % 1000 AS VARCHAR), 3, '0') || 'Z'"
FIELDS = "'{\"k\":\"' || f_k || '\",\"type\":\"' || f_type || '\",\"user\":\"' || f_user || '\"}'"


def _bodies(df: DataFrame, body) -> DataFrame:
    return df.select(body.cast("binary").alias("body"), F.lit(0).cast("bigint").alias("arrival"))


def _back(df: DataFrame) -> DataFrame:
    f = lambda k: F.col("fields")[k].alias(f"f_{k}")
    return df.where("error is null").select("ts", "host", "app", "severity", "message", f("k"), f("user"), f("type"))


FULL = "SELECT ts, host, app, severity, message, f_k, f_user, f_type FROM logs"


@query("decode_native_json", _logs(FULL))
def _(spark, d):
    return _back(decoders.decoded(_bodies(logs(spark, d), export.ndjson(False)), "json", compressed=False))


@query("decode_gelf", _logs(FULL))
def _(spark, d):
    e = F.struct(F.col("message").alias("short_message"), (F.col("ts")).alias("timestamp"), F.col("severity").alias("level"), "host", F.col("app").alias("_app"), *(F.col("fields")[k].alias(f"_{k}") for k in ("k", "user", "type")))
    return _back(decoders.decoded(_bodies(logs(spark, d), F.to_json(e)), "gelf"))


def _level_word(severity):
    return F.when(severity == 3, "error").when(severity == 4, "warning").when(severity == 5, "notice").when(severity == 6, "info").otherwise("debug")


@query("decode_loki_json", _logs(FULL))
def _(spark, d):
    values = F.array(F.array(F.concat(F.col("ts").cast("string"), F.lit("000000")), F.col("message")))
    stream = F.struct("host", F.col("app").alias("job"), _level_word(F.col("severity")).alias("level"), *(F.col("fields")[k].alias(k) for k in ("k", "user", "type")))
    return _back(decoders.decoded(_bodies(logs(spark, d), F.to_json(F.struct(F.array(F.struct(stream.alias("stream"), values.alias("values"))).alias("streams")))), "loki-json"))


def _attribute(key: str, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


@query("decode_otlp_json", _logs(FULL.replace("severity,", "CASE severity WHEN 5 THEN 6 ELSE severity END AS severity,")))
def _(spark, d):
    number = F.when(F.col("severity") == 3, 17).when(F.col("severity") == 4, 13).when(F.col("severity") <= 6, 9).otherwise(5)
    record = F.struct(F.concat(F.col("ts").cast("string"), F.lit("000000")).alias("timeUnixNano"), number.alias("severityNumber"), F.struct(F.col("message").alias("stringValue")).alias("body"), F.array(*(_attribute(k, F.col("fields")[k]) for k in ("k", "user", "type"))).alias("attributes"))
    resource = F.struct(F.array(_attribute("host.name", F.col("host")), _attribute("service.name", F.col("app"))).alias("attributes"))
    whole = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return _back(decoders.decoded(_bodies(logs(spark, d), F.to_json(whole)), "otlp-json"))


@query("decode_otlp_spans", _spans("SELECT trace_id, span_id, parent_id, name, service, host, start_us, duration_us, status FROM spans WHERE ltrim(trace_id, '0') <> '' AND ltrim(span_id, '0') <> ''"))
def _(spark, d):
    first = traces.first_spans(spans(spark, d))
    nanos = lambda us: F.concat(us.cast("string"), F.lit("000"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), "name", nanos(F.col("start_us")).alias("startTimeUnixNano"), nanos(F.col("start_us") + F.col("duration_us")).alias("endTimeUnixNano"), F.struct(F.col("status").alias("code")).alias("status"))
    resource = F.struct(F.array(_attribute("host.name", F.col("host")), _attribute("service.name", F.col("service"))).alias("attributes"))
    whole = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    made = decoders.decoded(_bodies(first, F.to_json(whole)), "otlp-json", spans=True)
    return made.where("error is null").select("trace_id", "span_id", "parent_id", "name", "service", "host", "start_us", "duration_us", "status")


def _lines(df: DataFrame, line) -> DataFrame:
    return df.select(line.alias("line"), F.lit("peer").alias("peer"), F.lit(0).cast("bigint").alias("arrival"))


@query("decode_syslog_5424", _logs(f"SELECT {PLAIN} FROM logs"))
def _(spark, d):
    return syslog.entries(_lines(logs(spark, d), export.rfc5424())).drop("fields", "arrival")


@query("decode_syslog_3164", _logs("SELECT ts // 1000 * 1000 AS ts, host, app, severity, message FROM logs"))
def _(spark, d):
    df = logs(spark, d)
    stamp = F.date_format(F.timestamp_millis("ts"), "MMM dd HH:mm:ss")
    line = F.concat(F.lit("<"), (8 + F.col("severity")).cast("string"), F.lit(">"), stamp, F.lit(" "), F.col("host"), F.lit(" "), F.col("app"), F.lit("[12]: "), F.col("message"))
    rows = df.select(line.alias("line"), F.lit("peer").alias("peer"), F.col("ts").alias("arrival"))
    return syslog.entries(rows, "utc").drop("fields", "arrival")


@query("decode_cef", _logs("SELECT ts, host, 'Spark|er' AS app, severity, f_type || ': ' || message AS message, f_user AS suser, f_k AS cn1 FROM logs"))
def _(spark, d):
    df = logs(spark, d)
    record = F.concat(F.lit(r"CEF:0|V|Spark\|er|1|7|"), F.col("fields")["type"], F.lit("|5|suser="), F.col("fields")["user"], F.lit(" msg="), F.replace("message", F.lit("="), F.lit(r"\=")), F.lit(" cn1="), F.col("fields")["k"])
    made = cef.enriched(df.withColumns({"message": record, "fields": F.lit(None).cast("map<string,string>")}))
    return made.select("ts", "host", "app", "severity", "message", F.col("fields")["suser"].alias("suser"), F.col("fields")["cn1"].alias("cn1"))


@query("export_csv", _logs(f"SELECT id || ',' || ts || ',' || {ISO} || ',' || host || ',' || app || ',' || severity || ',' || message || ',\"' || replace({FIELDS}, '\"', '\"\"') || '\"' AS line FROM logs"))
def _(spark, d):
    return logs(spark, d).select(export.csv_line().alias("line"))


@query("export_ndjson", _logs(f"SELECT '{{\"id\":' || id || ',\"ts\":' || ts || ',\"host\":\"' || host || '\",\"app\":\"' || app || '\",\"severity\":' || severity || ',\"message\":\"' || message || '\",\"fields\":' || {FIELDS} || '}}' AS line FROM logs"))
def _(spark, d):
    return logs(spark, d).select(export.ndjson().alias("line"))


@query("export_rfc5424", _logs(f"SELECT '<' || (8 + severity) || '>1 ' || {ISO} || ' ' || host || ' ' || app || ' - - [{export.SD_ID} k=\"' || f_k || '\" type=\"' || f_type || '\" user=\"' || f_user || '\"] ' || message AS line FROM logs"))
def _(spark, d):
    return logs(spark, d).select(export.rfc5424().alias("line"))


@query("export_terminal", _logs(f"SELECT {ISO} || ' ' || host || ' ' || app || ' ' || {NAMES.replace('CAST(grp AS INTEGER)', 'severity')} || ' ' || message || '  {{k=' || f_k || ' type=' || f_type || ' user=' || f_user || '}}' AS line FROM logs".replace("{{", "{").replace("}}", "}")))
def _(spark, d):
    return logs(spark, d).select(export.terminal_line().alias("line"))


@query("structured_logfmt", _logs("SELECT id, f_type AS kind, f_user AS \"user\" FROM logs"))
def _(spark, d):
    message = F.concat(F.lit("kind="), F.col("fields")["type"], F.lit(" user="), F.col("fields")["user"], F.lit(" units"))
    return logs(spark, d).select("id", enriched(message, F.lit(None).cast("map<string,string>")).alias("f")).select("id", F.col("f")["kind"].alias("kind"), F.col("f")["user"].alias("user"))


@query("structured_json", _logs("SELECT id, f_type AS kind, f_user AS \"user\", f_k AS k FROM logs"))
def _(spark, d):
    message = F.to_json(F.struct(F.col("fields")["type"].alias("kind"), F.struct(F.col("fields")["user"].alias("name"), F.col("fields")["k"].cast("int").alias("k")).alias("user")))
    return logs(spark, d).select("id", enriched(message, F.lit(None).cast("map<string,string>")).alias("f")).select("id", F.col("f")["kind"].alias("kind"), F.col("f")["user.name"].alias("user"), F.col("f")["user.k"].alias("k"))


@query("regex_parsers", _logs(r"SELECT id, CASE f_type WHEN 'error' THEN 3 ELSE severity END AS severity, split_part(message, ' took ', 2) AS message, f_user AS who, regexp_extract(message, 'took ([0-9]+)', 1) AS units FROM logs"))
def _(spark, d):
    p = [parsers.Parser(r"^(?P<lvl>error) user=(?P<who>\d+) took (?P<rest>(?P<units>\d+) units)$", "errors", level_from="lvl", message_from="rest"), parsers.Parser(r"^\w+ user=(?P<who>\d+) took (?P<rest>(?P<units>\d+) units)$", "others", message_from="rest")]
    return parsers.applied(logs(spark, d), p).select("id", "severity", "message", F.col("fields")["who"].alias("who"), F.col("fields")["units"].alias("units"))


@query("trace_ids", _logs("SELECT id, lower(md5(f_user)) AS trace_id FROM logs"))
def _(spark, d):
    fields = F.create_map(F.when(F.col("id") % 3 == 0, "TraceID").when(F.col("id") % 3 == 1, "trace_id").otherwise("X-B3-TraceId"), F.upper(F.md5(F.col("fields")["user"])))
    return logs(spark, d).select("id", with_trace_ids(fields).alias("f")).select("id", F.col("f")["trace_id"].alias("trace_id"))


@query("multiline_events", _logs("""SELECT host AS file, min(id) AS line, count(*) AS lines, string_agg(message, chr(10) ORDER BY id) AS text
    FROM (SELECT *, count_if(severity = 3) OVER (PARTITION BY host ORDER BY id) AS run FROM logs) GROUP BY host, run"""))
def _(spark, d):
    lines = logs(spark, d).select(F.col("host").alias("file"), F.col("id").alias("line"), F.col("message").alias("text"))
    return batch.joined_lines(lines, "^error", 10**9)


@query("audit_wanted", _logs("SELECT id FROM logs WHERE severity = 3 OR severity = 4 OR severity = 6"))
def _(spark, d):
    s = F.col("severity")
    rows = logs(spark, d).select("id", F.when(s == 4, "DELETE").when(s == 5, "POST").otherwise("GET").alias("method"), F.when(s == 5, "/loki/api/v1/push").when(s == 6, "/api/logs/7").otherwise("/api/stats").alias("path"), F.when(s == 3, 403).otherwise(200).alias("status"))
    return rows.where(audit_wanted(F.col("method"), F.col("path"), F.col("status"))).select("id")


@query("notice_texts", _logs(f"""SELECT host, 'Alert errors: ' || count(*) || ' matching entries within 6h0m on ' || host || '. Last: ' || arg_max(message, (ts, id)) AS text FROM logs WHERE severity = 3 AND ts >= {T0} GROUP BY host"""))
def _(spark, d):
    found = logs(spark, d).where(f"severity = 3 and ts >= {T0}").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max_by("message", F.struct("ts", "id")).alias("sample"))
    zero = F.lit(0)
    return found.select("host", messages.message(F.lit("alert"), F.col("host"), F.lit("errors"), F.col("n"), zero, F.lit(21_600), zero, F.col("sample")).alias("text"))


@query("prometheus_text", _logs(f"""SELECT '# HELP entries_total Entries by host and level' || chr(10) || '# TYPE entries_total counter' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) AS text
    FROM (SELECT 'entries_total{{host="' || host || '",level="' || {LEVEL} || '"}} ' || count(*) AS line FROM logs GROUP BY host, {LEVEL})""".replace("{{", "{").replace("}}", "}")))
def _(spark, d):
    from ..functions.scalars import level_label

    counts = logs(spark, d).groupBy("host", level_label(F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("count"))
    return forward.prometheus(counts, "entries_total", "Entries by host and level", ["host", "level"])


@query("forward_wanted", _logs("SELECT id FROM logs WHERE host LIKE 'host1%' AND severity IN (3, 4) AND regexp_matches(message, 'user=[0-9]1 ')"))
def _(spark, d):
    return forward.wanted(logs(spark, d), hosts=["host1*"], severities=[3, 4], pattern=r"user=\d1 ").select("id")

