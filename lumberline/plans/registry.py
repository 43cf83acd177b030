"""Registered queries over the driver's tables, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import DOC_LOGS_SQL, LOGS_SQL, SPANS_SQL, doc_logs, logs, spans
from ..functions.rules import Mask, Drop, applied as rules_applied
from ..functions.scalars import level_label, number, search_hint, severity_name, tags_of, template, truncated
from ..operators import hosts, maintenance, metrics, patterns, retention, search, stats, top, traces
from .fields import ColumnFilter, LineFilter
from .query import Access, Query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01
END = T0 + 30 * DAY - 1
TAGS = {"edge": ["host[12]", "host1", "host2"], "core": ["host7", "host8", "host9"], "odd": ["host?"]}


def query(name: str, sql: str | None = None):
    def put(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return put


def _logs(body: str, **parts: str) -> str:
    return f"WITH logs AS ({LOGS_SQL}) {body}"


def _docs(body: str) -> str:
    fold = r"' ' || trim(regexp_replace(strip_accents(lower(message)), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"
    return f"WITH logs AS (SELECT *, {fold} AS words FROM ({DOC_LOGS_SQL})) {body}"


def _spans(body: str) -> str:
    columns = "trace_id, span_id, parent_id, name, service, host, start_us, duration_us, status"
    first = "SELECT trace_id, span_id, min((parent_id, name, 0, service, host, start_us, duration_us, status)) AS r FROM raw GROUP BY ALL"
    parts = ", ".join(f"r[{i}] AS {c}" for i, c in ((1, "parent_id"), (2, "name"), (4, "service"), (5, "host"), (6, "start_us"), (7, "duration_us"), (8, "status")))
    return f"WITH raw AS ({SPANS_SQL}), firsts AS ({first}), spans AS (SELECT trace_id, span_id, {parts} FROM firsts) {body.replace('COLUMNS', columns)}"


ENTRY = "id, ts, host, app, severity, message"


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*ENTRY.split(", "))


def _searched(name: str, q: Query, where: str, docs: bool = False, order: str = "ts DESC, id DESC") -> None:
    """A search of 100 entries, newest first: the feature's page."""
    source, wrap = (doc_logs, _docs) if docs else (logs, _logs)
    query(name, wrap(f"SELECT {ENTRY} FROM logs WHERE {where} ORDER BY {order} LIMIT 100"))(lambda spark, d: _plain(search.search(source(spark, d), q, order.startswith("ts,"))))


_searched("search_newest", Query(), "true")
_searched("search_host_app_level", Query(host="host3", app="app2", level=4), "host = 'host3' AND app = 'app2' AND severity <= 4")
_searched("search_time_range", Query(since=T0 + DAY, until=T0 + 2 * DAY), f"ts BETWEEN {T0 + DAY} AND {T0 + 2 * DAY}")
_searched("search_page2", Query(cursor=(T0 + 20 * DAY, 5000)), f"(ts, id) < ({T0 + 20 * DAY}, 5000)")
_searched("search_level_set", Query(severities=[3, 5]), "severity IN (3, 5)")
_searched("search_level_set_empty", Query(severities=[]), "false")
_searched("search_field_eq", Query().also("type:purchase", "k=7"), "f_type = 'purchase' AND f_k = '7'")
_searched("search_field_ne", Query().also("type!=view"), "f_type <> 'view'")
_searched("search_field_num", Query().also("k>=90", "k<95.5"), "TRY_CAST(f_k AS DOUBLE) >= 90 AND TRY_CAST(f_k AS DOUBLE) < 95.5")
_searched("search_field_missing", Query().also("nothing!=x"), "false")
_searched("search_field_regex", Query().also("type~^(view|click)$"), "f_type IN ('view', 'click')")
_searched("search_message_regex", Query(message_regex=r"user=1\d took \d{2,3} "), r"regexp_matches(message, 'user=1[0-9] took [0-9]{2,3} ')")
_searched("search_line_filters", Query(lines=[LineFilter("|=", "took"), LineFilter("!=", "error"), LineFilter("|~", r"user=\d{2} "), LineFilter("!~", "^click")]), r"contains(message, 'took') AND NOT contains(message, 'error') AND regexp_matches(message, 'user=[0-9]{2} ') AND NOT regexp_matches(message, '^click')")
_searched("search_column_regex", Query(columns=[ColumnFilter("host", "=~", "host[1-3]"), ColumnFilter("app", "!~", "app(0|1)"), ColumnFilter("app", "!=", "app4")]), r"regexp_matches(host, '^host[1-3]$') AND app NOT IN ('app0', 'app1', 'app4')")
_searched("search_tag_glob", Query(host_globs=["host1*", "host[2]", "*9"]), "host LIKE 'host1%' OR host = 'host[2]' OR host LIKE '%9'")
_searched("search_access", Query(access=Access(["host1", "host2?", "h*5"], ["app?"])), "(host = 'host1' OR host LIKE 'host2_' OR host LIKE 'h%5') AND app LIKE 'app_'")
_searched("search_oldest_first", Query(), "true", order="ts, id")
_searched("search_text_and", Query(q="the of AND was"), "contains(words, ' the ') AND contains(words, ' of ') AND contains(words, ' was ')", docs=True)
_searched("search_text_or", Query(q="nicht der OR que los"), "(contains(words, ' nicht ') AND contains(words, ' der ')) OR (contains(words, ' que ') AND contains(words, ' los '))", docs=True)
_searched("search_text_phrase", Query(q='"of the"'), "contains(words, ' of the ')", docs=True)
_searched("search_text_prefix", Query(q="ent* -the"), "contains(words, ' ent') AND NOT contains(words, ' the ')", docs=True)
_searched("search_text_exclude", Query(q='-of -"la de" NOT und'), "NOT contains(words, ' of ') AND NOT contains(words, ' la de ') AND NOT contains(words, ' und ')", docs=True)
_searched("search_text_folded", Query(q="ÉÈ OR üB*"), "contains(words, ' ee ') OR contains(words, ' ub')", docs=True)


@query("search_text_live", _docs(f"SELECT {ENTRY} FROM logs WHERE contains(lower(message), 'heth') AND NOT contains(lower(message), 'nicht') ORDER BY ts DESC, id DESC LIMIT 100"))
def _(spark, d):
    from .query import predicate

    return _plain(doc_logs(spark, d).where(predicate(Query(q="HETH -nicht"), live=True)).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(100))


@query("export_oldest_first", _logs(f"SELECT {ENTRY} FROM logs WHERE host = 'host4' AND severity <= 4"))
def _(spark, d):
    return _plain(search.exported(logs(spark, d), Query(host="host4", level=4)))


BUCKET = 3_600_000


@query("stats_plain", _logs(f"SELECT ts // {BUCKET} * {BUCKET} AS bucket, count(*) AS n FROM logs GROUP BY 1"))
def _(spark, d):
    return stats.histogram(logs(spark, d), Query(), BUCKET)


def _filled(group: str | None, where: str, size: int, name: str = "grp", label: str = "grp") -> str:
    """Zero-filled buckets, ten largest groups and other."""
    calendar = f"SELECT b AS bucket FROM range({T0 // size * size}, {END // size * size + 1}, {size}) t(b)"
    if group is None:
        return _logs(f", found AS (SELECT ts // {size} * {size} AS bucket, count(*) AS n FROM logs WHERE {where} GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM ({calendar}) LEFT JOIN found USING (bucket)")
    return _logs(f""", found AS (SELECT ts // {size} * {size} AS bucket, {group} AS g, count(*) AS n FROM logs WHERE {where} GROUP BY ALL),
        ranked AS (SELECT g, row_number() OVER (ORDER BY sum(n) DESC, g) AS place FROM found GROUP BY g),
        folded AS (SELECT bucket, CASE WHEN place <= 10 THEN {label.replace("grp", "g")} ELSE 'other' END AS grp, sum(n)::BIGINT AS n FROM found JOIN ranked USING (g) GROUP BY ALL)
        SELECT bucket, grp, coalesce(n, 0) AS n FROM ({calendar}) LEFT JOIN folded USING (bucket)""").replace(") , found", "), found")


WINDOW = Query(since=T0, until=END)


def _window(**more) -> Query:
    return Query(since=T0, until=END, **more)


IN_WINDOW = f"ts BETWEEN {T0} AND {END}"
SIZE = 21_600_000  # what 30 days get


@query("stats_auto", _filled(None, IN_WINDOW, SIZE))
def _(spark, d):
    return stats.assembled(logs(spark, d), _window())


@query("stats_by_host", _filled("host", f"{IN_WINDOW} AND contains(message, 'error')", SIZE))
def _(spark, d):
    return stats.assembled(logs(spark, d), _window(q="error"), by="host")


NAMES = "list_extract(['emerg','alert','crit','err','warn','notice','info','debug'], CAST(grp AS INTEGER) + 1)"


@query("stats_by_severity", _filled("CAST(severity AS VARCHAR)", IN_WINDOW, DAY, label=NAMES))
def _(spark, d):
    return stats.assembled(logs(spark, d), _window(), DAY, "severity")


@query("stats_by_field_topn_other", _filled("f_k", IN_WINDOW, DAY))
def _(spark, d):
    return stats.assembled(logs(spark, d), _window(), DAY, "field.k")


SUMMARY = "host, count(*) AS count, count_if(severity <= 3)::BIGINT AS errors, count_if(severity = 4)::BIGINT AS warnings, max(ts) AS last_ts FROM logs GROUP BY host"
for _sort in ("count", "errors", "warnings", "last_ts"):
    query(f"host_summary_{_sort}", _logs(f"SELECT {SUMMARY} ORDER BY {_sort} DESC, host LIMIT 7"))(lambda spark, d, by=_sort: hosts.summary(logs(spark, d), Query(), by, limit=7))
query("host_summary_ascending", _logs(f"SELECT {SUMMARY} ORDER BY last_ts, host LIMIT 3"))(lambda spark, d: hosts.summary(logs(spark, d), Query(), "last_ts", False, 3))


@query(
    "host_form",
    _logs(f""", cells AS (SELECT host, least(11, greatest(0, (ts - {T0}) * 12 // {END - T0})) AS slice, severity FROM logs WHERE {IN_WINDOW}),
        found AS (SELECT host, slice, count(*) AS count, count_if(severity <= 3)::BIGINT AS errors, count_if(severity = 4)::BIGINT AS warnings FROM cells GROUP BY ALL)
        SELECT h.host, CAST(s AS INTEGER) AS slice, coalesce(count, 0) AS count, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
        FROM (SELECT DISTINCT host FROM cells) h CROSS JOIN range(12) t(s) LEFT JOIN found f ON f.host = h.host AND f.slice = s""").replace(") , cells", "), cells"),
)
def _(spark, d):
    return hosts.form(logs(spark, d), _window(), 12)


NOW = T0 + 29 * DAY + 12_345


@query(
    "host_window_counts",
    _logs(f""", found AS (SELECT host, ts // {BUCKET} - {NOW // BUCKET - 24} AS w, count(*) AS n FROM logs WHERE ts >= {(NOW // BUCKET - 24) * BUCKET} AND ts < {NOW // BUCKET * BUCKET} GROUP BY ALL)
        SELECT h.host, CAST(i AS INTEGER) AS "window", coalesce(n, 0) AS n FROM (SELECT DISTINCT host FROM found) h CROSS JOIN range(24) t(i) LEFT JOIN found f ON f.host = h.host AND f.w = i"""),
)
def _(spark, d):
    return hosts.window_counts(logs(spark, d), NOW, BUCKET, 24)


@query("storage_summary", _logs(f"SELECT count(*) AS entries, min(ts) AS oldest, max(ts) AS newest, count_if(ts > {NOW - DAY})::BIGINT AS last_day FROM logs"))
def _(spark, d):
    return hosts.storage(logs(spark, d), NOW)


@query("known_hosts", _logs("SELECT DISTINCT host FROM logs ORDER BY host LIMIT 5"))
def _(spark, d):
    return hosts.known(logs(spark, d), 5)


@query(
    "board_states",
    _logs(f", rows AS (SELECT {SUMMARY}) SELECT host, count, errors, warnings, last_ts, CASE WHEN {NOW} - last_ts > {DAY // 24} THEN 'silent' WHEN errors >= 200 THEN 'failing' WHEN errors >= 100 OR warnings >= 200 THEN 'degraded' ELSE 'healthy' END AS state FROM rows"),
)
def _(spark, d):
    return hosts.board(logs(spark, d), Query(), NOW, DAY // 24, 200, 100).drop("rank")


HALF = T0 + 15 * DAY


@query(
    "compare_windows",
    _logs(f"""SELECT host, count_if(ts < {HALF})::BIGINT AS before, count_if(ts < {HALF} AND severity <= 3)::BIGINT AS before_errors, count_if(ts >= {HALF})::BIGINT AS after,
        count_if(ts >= {HALF} AND severity <= 3)::BIGINT AS after_errors, count_if(ts >= {HALF})::BIGINT - count_if(ts < {HALF})::BIGINT AS change FROM logs WHERE {IN_WINDOW} GROUP BY host"""),
)
def _(spark, d):
    return hosts.compared(logs(spark, d), Query(since=T0, until=HALF - 1), Query(since=HALF, until=END))


query("top_host", _logs("SELECT host AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, value LIMIT 10"))(lambda spark, d: top.top(logs(spark, d), Query(), "host"))
query("top_severity", _logs("SELECT CAST(severity AS VARCHAR) AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, value LIMIT 10"))(lambda spark, d: top.top(logs(spark, d), Query(), "severity"))
query("top_field", _logs("SELECT f_k AS value, count(*) AS n FROM logs WHERE severity <= 5 GROUP BY 1 ORDER BY n DESC, value LIMIT 10"))(lambda spark, d: top.top(logs(spark, d), Query(level=5), "k"))
query(
    "top_totals",
    _logs(", v AS (SELECT f_user AS value, count(*) AS n FROM logs GROUP BY 1) SELECT sum(n)::BIGINT AS matching, sum(n)::BIGINT AS with_field, count(*) AS \"distinct\", sum(n)::BIGINT - (SELECT sum(n)::BIGINT FROM (SELECT n FROM v ORDER BY n DESC, value LIMIT 10)) AS other FROM v"),
)(lambda spark, d: top.totals(logs(spark, d), Query(), "user"))
query("field_names", _logs("SELECT key, count(*) AS n FROM logs CROSS JOIN (VALUES ('k'), ('type'), ('user')) t(key) WHERE host = 'host1' GROUP BY key"))(lambda spark, d: top.field_names(logs(spark, d), Query(host="host1")))

TEMPLATE = r"regexp_replace(regexp_replace(substr(message, 1, 400), 'user=[^ ]+', 'user=<*>'), 'took [^ ]+', 'took <*>')"
SAMPLE = f"SELECT *, {TEMPLATE} AS template FROM (SELECT * FROM logs WHERE {IN_WINDOW} ORDER BY ts DESC, id DESC LIMIT 20000)"
MIDDLE = T0 + (END - T0) // 2
GROUPED = f"""SELECT template, count(*) AS count, count_if(ts < {MIDDLE})::BIGINT AS previous, count_if(ts >= {MIDDLE})::BIGINT AS recent, least(100, count(DISTINCT host)) AS hosts,
    {NAMES.replace("CAST(grp AS INTEGER)", "min(severity)")} AS severity, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(id, (ts, id)) AS id, arg_max(message, (ts, id)) AS example,
    split_part(template, ' ', 1) || ' user took units' AS search FROM s GROUP BY template"""


@query("patterns", _logs(f", s AS ({SAMPLE}) {GROUPED} ORDER BY count DESC, template LIMIT 25"))
def _(spark, d):
    return patterns.patterns(logs(spark, d), _window())


query("patterns_totals", _logs(f", s AS ({SAMPLE}) SELECT count(DISTINCT template) AS \"distinct\", CAST(0 AS BIGINT) AS other, (SELECT count(*) FROM logs WHERE {IN_WINDOW}) > 20000 AS truncated, CASE WHEN (SELECT count(*) FROM logs WHERE {IN_WINDOW}) > 20000 THEN (SELECT min(ts) FROM s) ELSE {T0} END AS since FROM s"))(
    lambda spark, d: patterns.totals(logs(spark, d), _window())
)
query("patterns_first_seen", _logs(f"SELECT {TEMPLATE} AS template, min(ts) AS first_ts, arg_min(id, (ts, id)) AS first_id FROM logs GROUP BY 1"))(lambda spark, d: patterns.first_seen(logs(spark, d)))
query("templates_of_messages", _logs(f"SELECT id, {TEMPLATE} AS template, split_part(message, ' ', 1) || ' user took units' AS hint FROM logs"))(
    lambda spark, d: logs(spark, d).select("id", template(F.col("message")).alias("template")).withColumn("hint", search_hint(F.col("template")))
)


def _halves(a: int, b: int) -> str:
    return f"SELECT {TEMPLATE} AS template, count(*) AS n FROM (SELECT * FROM logs WHERE ts BETWEEN {a} AND {b} ORDER BY ts DESC, id DESC LIMIT 20000) GROUP BY 1"


@query(
    "patterns_compared_logs",
    _logs(f""", one AS ({_halves(T0, T0 + 3 * DAY)}), two AS ({_halves(T0 + 3 * DAY + 1, END)})
        SELECT * FROM (SELECT coalesce(one.template, two.template) AS template, coalesce(one.n, 0) AS before, coalesce(two.n, 0) AS after,
            CASE WHEN one.n IS NULL THEN 'appeared' WHEN two.n IS NULL THEN 'gone' WHEN two.n >= 2 * one.n THEN 'more' END AS change FROM one FULL JOIN two USING (template)) WHERE change IS NOT NULL"""),
)
def _(spark, d):
    return patterns.compared(logs(spark, d), Query(since=T0, until=T0 + 3 * DAY), Query(since=T0 + 3 * DAY + 1, until=END))


@query("patterns_compared")
def _(spark, d):
    return patterns.compared(doc_logs(spark, d), Query(since=0, until=500 * 60000), Query(since=500 * 60000 + 1, until=10**12))


def _context(same: bool) -> str:
    host = "AND l.host = h.host" if same else ""
    side = lambda op, way, name: f"(SELECT {', '.join('l.' + c for c in ENTRY.split(', '))}, '{name}' AS side FROM logs l, h WHERE (l.ts, l.id) {op} (h.ts, h.id) {host} ORDER BY l.ts {way}, l.id {way} LIMIT 5)"
    return _logs(f", h AS (SELECT ts, id, host FROM logs WHERE id = 500) SELECT * FROM {side('<', 'DESC', 'before')} UNION ALL SELECT * FROM {side('>', 'ASC', 'after')}")


for _same, _name in ((True, "context_same_host"), (False, "context_all")):
    query(_name, _context(_same))(lambda spark, d, same=_same: search.context(logs(spark, d).drop("fields"), 500, 5, same).select(*ENTRY.split(", "), "side"))
query("recent_samples", _logs("SELECT host, id, ts, message FROM logs QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) <= 3"))(lambda spark, d: search.newest_per(logs(spark, d), "host", 3).select("host", "id", "ts", "message"))

LEVEL = "CASE WHEN severity <= 2 THEN 'critical' WHEN severity = 3 THEN 'error' WHEN severity = 4 THEN 'warning' WHEN severity <= 6 THEN 'info' ELSE 'debug' END"


@query("logql_streams", _logs(f"SELECT host, app, {LEVEL} AS level, CAST(ts AS VARCHAR) || '000000' AS ts_ns, message AS line FROM logs WHERE host IN ('host1', 'host2') AND severity <= 4 AND contains(message, 'took') AND {IN_WINDOW} ORDER BY ts DESC, id DESC LIMIT 100"))
def _(spark, d):
    return metrics.streams(logs(spark, d), '{host=~"host1|host2", level=~"error|warning"} |= "took" | json', T0, END)


def _matrix(keys: str, where: str, start: int, end: int, step: int, width: int, rate: bool = False) -> str:
    value = f"count(*) / ({width} / 1000.0)::DOUBLE" if rate else "count(*)"
    names = keys + ", " if keys else ""
    return _logs(f", steps AS (SELECT t FROM range({start}, {end} + 1, {step}) s(t)) SELECT {names}t, {value} AS value FROM logs JOIN steps ON ts > t - {width} AND ts <= t WHERE {where} GROUP BY ALL")


for _name, _text, _keys, _where, _step, _width in (
    ("logql_count_matrix", 'sum by (host) (count_over_time({app="app1"}[6h]))', "host", "app = 'app1'", 21_600_000, 21_600_000),
    ("logql_sliding", 'sum(count_over_time({} !~ "click"[12h]))', "", "NOT contains(message, 'click')", 7_200_000, 43_200_000),
    ("logql_sparse", 'sum by (level) (count_over_time({host!="host0"} | k >= 50[1h]))', f"{LEVEL} AS level", "host <> 'host0' AND TRY_CAST(f_k AS DOUBLE) >= 50", DAY, 3_600_000),
    ("logql_per_stream", 'count_over_time({level="error"}[1d])', f"host, app, {LEVEL} AS level", "severity = 3", DAY, DAY),
    ("logql_rate_by_field", 'sum by (type) (rate({type!="view"}[1d]))', "f_type AS type", "f_type <> 'view'", DAY, DAY),
):
    query(_name, _matrix(_keys, _where, T0 + DAY, T0 + 20 * DAY, _step, _width, "rate(" in _text))(lambda spark, d, text=_text, step=_step: metrics.matrix(logs(spark, d), text, T0 + DAY, T0 + 20 * DAY, step))


@query("logql_vector", _logs(f"SELECT host, count(*) AS value FROM logs WHERE ts > {HALF - DAY} AND ts <= {HALF} AND app = 'app3' GROUP BY host"))
def _(spark, d):
    return metrics.vector(logs(spark, d), 'sum by (host) (count_over_time({service="app3"}[1d]))', HALF)


query("logql_labels", "SELECT label FROM (VALUES ('app'), ('host'), ('k'), ('level'), ('type'), ('user')) t(label)")(lambda spark, d: metrics.label_names(logs(spark, d), _window()))
query("logql_label_values", _logs(f"SELECT DISTINCT {LEVEL} AS value FROM logs WHERE {IN_WINDOW}"))(lambda spark, d: metrics.label_values(logs(spark, d), _window(), "level"))
query("logql_series", _logs(f"SELECT DISTINCT host, app, {LEVEL} AS level FROM logs WHERE (host = 'host1' OR (app = 'app2' AND severity = 3)) AND {IN_WINDOW}"))(lambda spark, d: metrics.series(logs(spark, d), ['{host="host1"}', '{app="app2", level="error"}'], T0, END))


@query("log_metrics", _logs("SELECT host, count(*) AS count, sum(CAST(f_k AS DOUBLE)) AS sum FROM logs WHERE severity <= 4 GROUP BY host"))
def _(spark, d):
    return metrics.log_metrics(logs(spark, d), Query(level=4), ["host"], "k")


@query(
    "log_metrics_overflow",
    _logs(", g AS (SELECT f_user AS \"user\", count(*) AS count, 0.0::DOUBLE AS sum, min((ts, id)) AS first FROM logs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first) AS place FROM g) SELECT CASE WHEN place <= 50 THEN \"user\" ELSE '_other' END AS \"user\", sum(count)::BIGINT AS count, sum(sum) AS sum FROM r GROUP BY 1"),
)
def _(spark, d):
    return metrics.log_metrics(logs(spark, d), Query(), ["user"], None, 50)


SPAN_T0 = 788_918_400_000  # 1995-01-01
SPAN_T1 = SPAN_T0 + 365 * DAY


def _trace_list(having: str) -> str:
    return _spans(f""", page AS (SELECT trace_id, min(start_us) AS start_us, max(start_us + duration_us) - min(start_us) AS duration_us, count(*) AS spans, count_if(status = 2)::BIGINT AS errors,
            array_to_string(list_sort(list(DISTINCT service)), ',') AS services, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts
        FROM spans WHERE start_us BETWEEN {SPAN_T0}000 AND {SPAN_T1}999 GROUP BY trace_id HAVING {having} ORDER BY start_us DESC, trace_id LIMIT 50),
        roots AS (SELECT trace_id, arg_min((name, service), (CASE WHEN parent_id = '' THEN 0 ELSE 1 END, start_us, span_id)) AS root FROM spans GROUP BY trace_id)
        SELECT trace_id, start_us // 1000 AS start_ms, duration_us, spans, errors, services, hosts, root[1] AS root_name, root[2] AS root_service FROM page JOIN roots USING (trace_id)""")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("services", "hosts")})


query("trace_list", _trace_list("true"))(lambda spark, d: _flat(traces.listed(traces.first_spans(traces.in_window(spans(spark, d), SPAN_T0, SPAN_T1)), SPAN_T0, SPAN_T1)))
query("trace_list_filtered", _trace_list("bool_or(service = 'R-F') AND bool_or(contains(lower(name), 'r f')) AND bool_or(duration_us >= 40000) AND count_if(status = 2) > 0"))(
    lambda spark, d: _flat(traces.listed(traces.first_spans(traces.in_window(spans(spark, d), SPAN_T0, SPAN_T1)), SPAN_T0, SPAN_T1, service="R-F", name="R f", min_us=40_000, errors=True))
)
query("trace_list_access", _trace_list("bool_and(host LIKE 'node%' AND (service = 'A-F' OR service LIKE 'N-%'))"))(
    lambda spark, d: _flat(traces.listed(traces.first_spans(traces.in_window(spans(spark, d), SPAN_T0, SPAN_T1)), SPAN_T0, SPAN_T1, access=Access(["node*"], ["A-F", "N-*"])))
)
query("trace_spans", _spans("SELECT COLUMNS FROM spans WHERE trace_id = lpad('7', 32, '0') ORDER BY start_us, span_id"))(lambda spark, d: traces.detail(traces.first_spans(spans(spark, d)), "7".zfill(32)).drop("kind", "status_message", "attributes", "events"))
query("trace_root", _spans(", r AS (SELECT trace_id, arg_min((name, service), (CASE WHEN parent_id = '' THEN 0 ELSE 1 END, start_us, span_id)) AS root FROM spans GROUP BY trace_id) SELECT trace_id, root[1] AS root_name, root[2] AS root_service FROM r"))(
    lambda spark, d: traces.roots(traces.first_spans(spans(spark, d)))
)
query("span_upsert", _spans("SELECT COLUMNS FROM spans"))(lambda spark, d: traces.first_spans(spans(spark, d)).drop("kind", "status_message", "attributes", "events"))

RULES = [retention.Rule(["host1*"], [], [], T0 + 10 * DAY), retention.Rule(["host2"], [], [3], None), retention.Rule([], ["app3"], [], T0 + 20 * DAY)]
CUTOFFS = {7: T0 + 25 * DAY, 6: T0 + 15 * DAY}


@query(
    "retention_keep",
    _logs(f"""SELECT {ENTRY} FROM logs WHERE CASE WHEN host LIKE 'host1%' THEN ts >= {T0 + 10 * DAY} WHEN host = 'host2' AND severity = 3 THEN true WHEN app = 'app3' THEN ts >= {T0 + 20 * DAY}
        WHEN severity = 7 THEN ts >= {T0 + 25 * DAY} WHEN severity = 6 THEN ts >= {T0 + 15 * DAY} ELSE true END"""),
)
def _(spark, d):
    return _plain(retention.split(logs(spark, d), RULES, CUTOFFS)[0])


@query("retention_archive_counts", _logs(f"SELECT host, count(*) AS n FROM logs WHERE severity = 7 AND ts < {T0 + 25 * DAY} OR severity = 6 AND ts < {T0 + 15 * DAY} GROUP BY host"))
def _(spark, d):
    return retention.split(logs(spark, d), [], CUTOFFS)[1].groupBy("host").agg(F.count(F.lit(1)).alias("n"))


SIZED = "20 + strlen(host) + strlen(app) + strlen(message) + strlen('{\"k\":\"' || f_k || '\",\"type\":\"' || f_type || '\",\"user\":\"' || f_user || '\"}')"


@query("size_cap", _logs(f", r AS (SELECT *, sum({SIZED}) OVER (ORDER BY ts DESC, id DESC) AS run, sum({SIZED}) OVER () AS total FROM logs) SELECT {ENTRY} FROM r WHERE total <= 500000 OR run <= 450000"))
def _(spark, d):
    return _plain(retention.within_size(logs(spark, d), 500_000))


@query("severity_names", _logs(f"SELECT id, {NAMES.replace('CAST(grp AS INTEGER)', 'severity')} AS name, {LEVEL} AS level FROM logs"))
def _(spark, d):
    return logs(spark, d).select("id", severity_name(F.col("severity")).alias("name"), level_label(F.col("severity")).alias("level"))


@query("truncated_messages", _docs("SELECT id, CASE WHEN strlen(message) <= 100 THEN message ELSE (SELECT substr(message, 1, max(i)) FROM range(101) t(i) WHERE strlen(substr(message, 1, i)) <= 100) END AS message FROM logs"))
def _(spark, d):
    return doc_logs(spark, d).select("id", truncated(F.col("message"), 100).alias("message"))


@query("field_numbers", _logs("SELECT id, CAST(f_k AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS word FROM logs"))
def _(spark, d):
    return logs(spark, d).select("id", number(F.col("fields")["k"]).alias("k"), number(F.col("fields")["type"]).alias("word"))


@query("mask_and_drop", _logs(r"SELECT id, regexp_replace(message, 'user=([0-9])[0-9]*', 'user=\1**', 'g') AS message, regexp_replace(f_user, '^[0-9]+$', '#') AS masked FROM logs WHERE NOT (app = 'app2' AND severity IN (6, 7))"))
def _(spark, d):
    rules = [Mask(r"user=(\d)\d*", "user=$1**"), Drop(apps=["app2"], severities=[6, 7])]
    masked = rules_applied(logs(spark, d), rules)
    only = rules_applied(masked.withColumn("user", F.create_map(F.lit("user"), F.col("fields")["user"])).select("id", "host", "app", "severity", F.col("user").alias("fields"), F.lit("").alias("message")), [Mask(r"^\d+$", "#")])
    return masked.select("id", "message").join(only.select("id", F.col("fields")["user"].alias("masked")), "id")


@query("tags_of_hosts", _logs("SELECT DISTINCT host, concat_ws(',', CASE WHEN host IN ('host[12]', 'host1', 'host2') THEN 'edge' END, CASE WHEN host IN ('host7', 'host8', 'host9') THEN 'core' END, CASE WHEN length(host) = 5 THEN 'odd' END) AS tags FROM logs"))
def _(spark, d):
    return logs(spark, d).select("host").distinct().select("host", F.array_join(tags_of(F.col("host"), TAGS), ",").alias("tags"))


@query(
    "maintenance_active",
    _logs(f"""SELECT id, CASE WHEN host = 'host1' AND ts >= {T0 + DAY} AND ts < {T0 + 2 * DAY} THEN 'upgrade'
        WHEN host LIKE 'host_' AND ((ts // 60000) % 1440 >= 1380 OR (ts // 60000) % 1440 < 60) THEN 'nightly' END AS muted FROM logs WHERE severity = 3"""),
)
def _(spark, d):
    windows = [maintenance.Once(["host1"], T0 + DAY, T0 + 2 * DAY, "upgrade"), maintenance.Weekly(["host?"], 1380, 60, "nightly")]
    return logs(spark, d).where("severity = 3").select("id", maintenance.reason(F.col("host"), F.col("ts"), windows).alias("muted"))


@query("silence_gaps", _logs(f"SELECT host, ts AS last, next - ts AS gap FROM (SELECT host, ts, lead(ts) OVER (PARTITION BY host ORDER BY ts, id) AS next FROM logs) WHERE next - ts > {DAY // 8}"))
def _(spark, d):
    return maintenance.silence_gaps(logs(spark, d), DAY // 8)


from . import machine_queries, wire_queries  # noqa: E402, F401
