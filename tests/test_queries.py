"""Searches, predicates and the analytic family on small tables with known answers."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lumberline.functions.regexes import Regex
from lumberline.functions.scalars import glob_regex, number, search_hint, template, truncated
from lumberline.operators import hosts, metrics, patterns, retention, search, stats, top, traces
from lumberline.plans import durations, logql, text
from lumberline.plans.fields import ColumnFilter, LineFilter, parse_expression
from lumberline.plans.query import Access, Query, parse_cursor, predicate, resolve_tags


def times(df):
    return sorted(r.ts for r in df.collect())


TEXTS = [(1, "h", 6, "disk error on sda"), (2, "h", 6, "disk timeout on sdb"), (3, "h", 6, "network error eth0"), (4, "h", 7, "debug disk scan"), (5, "h", 6, "failed login for root"), (6, "h", 6, "failure to mount")]


def test_search_text(entries):
    logs = entries(TEXTS).cache()
    for q, want in {
        "disk error": [1],
        "disk NOT sda": [2, 4],
        "error OR timeout": [1, 2, 3],
        "disk -sda -timeout": [4],
        "disk error OR network": [1, 3],
        "-disk -error": [5, 6],
        '"disk error"': [1],
        '"on sda" OR "eth0"': [1, 3],
        '"error disk"': [],
        "DISK ERROR": [1],
        "fail*": [5, 6],
        "disk or error": [],
        "disk -debug": [1, 2],
        '"..." disk': [1, 2, 4],
        '"..."': [],
        "": [1, 2, 3, 4, 5, 6],
    }.items():
        assert times(logs.where(predicate(Query(q=q)))) == want, q
        if "..." not in q and q != "disk or error":
            assert set(want) <= set(times(logs.where(predicate(Query(q=q), live=True)))), q


def test_search_text_parser():
    t = text.Term
    assert text.parse('a "b c"* -d NOT e f* OR g AND h - i').any_of == [[t("a"), t("b c", True), t("f", True)], [t("g"), t("h"), t("i")]]
    assert text.parse('a "b c"* -d NOT e f*').none_of == [t("d"), t("e")]
    assert text.parse('x "open end').any_of == [[t("x"), t("open end")]]
    assert text.parse("a\0b").any_of == [[t("a"), t("b")]]
    assert not text.parse(' OR AND - "" * ')
    assert text.parse('-"a b" "OR"').any_of == [[t("OR")]]


def test_search_text_against_an_index(spark, entries):
    """Words, phrases and prefixes against SQLite's full-text index on its default tokenizer."""
    rng = random.Random(3)
    words = ["disk", "Él", "Niño", "el", "nino", "baz_1", "baz", "1", "ß", "Straße", "über", "uber", "a-b", "e.f", "Ωmega", "x"]
    rows = [(i, "h", 6, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    logs = entries(rows).cache()
    index = sqlite3.connect(":memory:")
    index.execute("CREATE VIRTUAL TABLE t USING fts5(m)")
    index.executemany("INSERT INTO t(rowid, m) VALUES (?, ?)", [(r[0] + 1, r[3]) for r in rows])
    for _ in range(25):
        picked = [rng.choice(words) for _ in range(rng.randint(1, 2))]
        phrase, prefix = " ".join(picked), rng.random() < 0.3
        quoted = f'"{phrase}"' + "*" * prefix
        want = sorted(r[0] - 1 for r in index.execute("SELECT rowid FROM t WHERE t MATCH ?", (quoted,)))
        assert times(logs.where(predicate(Query(q=quoted)))) == want, quoted


FIELDS = [
    (1, "a", 6, "GET /x 200", {"status": "200", "d": "0.5s", "role": "web"}),
    (2, "a", 6, "GET /y 503", {"status": "503", "d": "2.5", "role": "web"}),
    (3, "b", 6, "GET /z 404", {"status": "404", "d": "10", "role": "db"}),
    (4, "b", 6, "no fields here", None),
    (5, "c", 6, "GET /w 500", {"status": "500", "d": "1e1", "role": "cache"}),
]


def test_field_comparisons(entries):
    logs = entries(FIELDS).cache()
    for exprs, want in {("status>=500",): [2, 5], ("status>500",): [2], ("status<=404",): [1, 3], ("status<300",): [1], ("d>=1",): [2, 3, 5], ("d<1",): [], ("role!=web",): [3, 5], ("role~^(db|cache)$",): [3, 5], ("status>=400", "role:web"): [2], ("status>=400", "status<=503"): [2, 3, 5], ("role=db",): [3]}.items():
        for live in (False, True):
            assert times(logs.where(predicate(Query().also(*exprs), live))) == want, exprs
    assert times(logs.where(predicate(Query(message_regex="GET /[xy] ")))) == [1, 2]
    assert times(logs.where(predicate(Query(message_regex="(?i)NO FIELDS")))) == [4]
    assert times(logs.where(predicate(Query(q="GET", access=Access(["a", "c"])).also("status>=400")))) == [2, 5]
    for bad in ("status", "a b:1", ":x", "k>x", "k>=nan", "k~(", "k!", "k>inf"):
        with pytest.raises(ValueError):
            parse_expression(bad)


def test_lines_columns_severities(entries):
    rows = [(1, "web1", 3, "upstream timed out (110)", None, "nginx"), (2, "web2", 6, "GET /index 200", None, "nginx"), (3, "db1", 4, "slow query: 3.1s", None, "pg"), (4, "db1", 6, "checkpoint complete", None, "pg"), (5, "", 7, "Debug (lib) tick", None, "")]
    logs = entries(rows).cache()
    for q, want in (
        (Query(lines=[LineFilter("|=", "timed out")]), [1]),
        (Query(lines=[LineFilter("|=", "(lib)")]), [5]),
        (Query(lines=[LineFilter("|=", "debug")]), []),
        (Query(lines=[LineFilter("!=", "GET")]), [1, 3, 4, 5]),
        (Query(lines=[LineFilter("|~", r"\d+\.\ds$")]), [3]),
        (Query(lines=[LineFilter("!~", "^(GET|slow)")]), [1, 4, 5]),
        (Query(lines=[LineFilter("|=", "e"), LineFilter("!=", "query")]), [1, 2, 4, 5]),
        (Query(columns=[ColumnFilter("host", "=", "db1")]), [3, 4]),
        (Query(columns=[ColumnFilter("host", "!=", "db1")]), [1, 2, 5]),
        (Query(columns=[ColumnFilter("app", "=~", "(nginx|pg)")]), [1, 2, 3, 4]),
        (Query(columns=[ColumnFilter("host", "!~", "web.*")]), [3, 4, 5]),
        (Query(severities=[3, 4]), [1, 3]),
        (Query(severities=[]), []),
        (Query(lines=[LineFilter("!=", "GET")], access=Access(["web1", "db1"]), severities=[3, 6]), [1, 4]),
    ):
        assert times(logs.where(predicate(q))) == want, q


def test_globs_tags_access(entries):
    logs = entries([(i, h, 6, "m") for i, h in enumerate(["web1", "web2", "web10", "db1", "proxy1", "[odd]", "a*b"], 1)]).cache()
    for patterns_, want in {("web*",): [1, 2, 3], ("web?",): [1, 2], ("web*", "db1"): [1, 2, 3, 4], ("*1",): [1, 4, 5], ("[odd]",): [6], ("[odd]*",): [6], ("a*b",): [7], ("nothing*",): []}.items():
        assert times(logs.where(predicate(Query(host_globs=list(patterns_))))) == want
    tag = resolve_tags(["t"], {"t": ["web*", "db1"]})
    assert times(logs.where(predicate(Query(host_globs=tag, access=Access(["web1*", "proxy1"]))))) == [1, 3]
    assert times(logs.where(predicate(Query(access=Access(["db*", "proxy?"]))))) == [4, 5]
    with pytest.raises(ValueError, match="known: t"):
        resolve_tags(["u"], {"t": []})
    assert search.context(logs, 5, access=Access(["web*", "db1"])).count() == 0
    assert search.context(logs, 1, same_host=False, access=Access(["web*", "db1"], ["app"])).count() == 3
    assert glob_regex("**") == r"(?s)^.*\z"


def test_histogram(entries):
    rows = [(100, "pve", 6, "boot"), (900, "nas", 6, "sync"), (1500, "pve", 3, "disk error", {"act": "blocked"}), (1999, "nas", 3, "disk error"), (2000, "pve", 6, "next bucket")]
    logs = entries(rows)
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(stats.histogram(logs, Query(), 1000)) == [(0, 2), (1000, 2), (2000, 1)]
    assert got(stats.histogram(logs, Query(), 1000, "host")) == [(0, "nas", 1), (0, "pve", 1), (1000, "nas", 1), (1000, "pve", 1), (2000, "pve", 1)]
    assert got(stats.histogram(logs, Query(q="disk", level=3, since=1000), 1000, "severity")) == [(1000, "3", 2)]
    assert got(stats.histogram(logs, Query(), 2000, "act")) == [(0, "", 3), (0, "blocked", 1), (2000, "", 1)]
    with pytest.raises(ValueError):
        stats.histogram(logs, Query(), 1000, "a b")
    filled = stats.assembled(entries([(60000, "a", 6, "m")] * 3 + [(180000, "a", 6, "m")]), Query(since=60000, until=200000), 60000)
    assert got(filled) == [(60000, 3), (120000, 0), (180000, 1)]
    many = entries([(0, f"h{i:02}", 6, "m") for i in range(13) for _ in range(100 - i)])
    folded = stats.assembled(many, Query(since=0, until=10), 1000, "host").collect()
    assert len(folded) == 11 and {r.grp: r.n for r in folded}["other"] == 90 + 89 + 88
    with pytest.raises(ValueError):
        stats.assembled(many, Query(since=0, until=10**9), 1000)


def test_durations_and_times():
    assert [durations.auto_bucket_ms(x) for x in (3_600_000, 900_000, 86_400_000, 604_800_000, 10**15)] == [30_000, 10_000, 900_000, 10_800_000, 604_800_000]
    assert [durations.bucket_ms(x) for x in ("", "0", "0s", "m", "5x", "-5m", "500ms", "9" * 30)] == [None] * 8
    assert [durations.bucket_ms(x) for x in ("90", "30s", "1h30m", "1d")] == [90_000, 30_000, 5_400_000, 86_400_000]
    assert [durations.duration_ms(x) for x in ("500ms", "30s", "5m", "1h30m", "2d", "1w", "1.5s")] == [500, 30_000, 300_000, 5_400_000, 172_800_000, 604_800_000, 1500]
    assert [durations.duration_ms(x) for x in ("", "5", "m", "5x", "0s", "-1s", "1h xx")] == [None] * 7
    for t in ("1791028800", "1791028800000", "1791028800000000", "1791028800000000000", "2026-10-03T12:00:00Z", "2026-10-03T14:00:00+02:00", "2026-10-03T07:30:00-04:30"):
        assert durations.time_ms(t) == 1791028800000, t
    for bad in ("", "x", "2026-13-01T00:00:00Z", "-5"):
        with pytest.raises(ValueError):
            durations.time_ms(bad)
    assert durations.step_ms("1.5") == 1500 and durations.step_ms("1m") == 60_000
    with pytest.raises(ValueError):
        durations.step_ms("0")


def test_host_summary_and_form(entries):
    rows = [(100, "pve", 6), (200, "pve", 3), (300, "pve", 4), (150, "nas", 2), (400, "pve", 7), (50, "ups", 6)]
    logs = entries([(*r, "m") for r in rows])
    assert [tuple(r) for r in hosts.summary(logs, Query()).collect()] == [("pve", 4, 1, 1, 400), ("nas", 1, 1, 0, 150), ("ups", 1, 0, 0, 50)]
    spread = {"alpha": "100:6 900:3", "bravo": "300:6 310:4 320:6", "charlie": "500:3 510:3 520:6 530:4 540:4"}
    logs = entries([(int(x.split(":")[0]), h, int(x.split(":")[1]), "m") for h, xs in spread.items() for x in xs.split()])
    order = lambda *a: "".join(r.host[0] for r in hosts.summary(logs, Query(), *a).collect())
    assert [order("count"), order("errors"), order("warnings"), order("last_ts"), order("last_ts", False, 1)] == ["cba", "cab", "cba", "acb", "b"]
    logs = entries([(100, "pve", 6, "m"), (150, "pve", 3, "m"), (320, "pve", 4, "m"), (499, "pve", 6, "m"), (500, "pve", 6, "m"), (260, "nas", 6, "m")])
    form = {(r.host, r.slice): (r["count"], r.errors, r.warnings) for r in hosts.form(logs, Query(since=100, until=500), 4).collect()}
    assert [form["pve", i] for i in range(4)] == [(2, 1, 0), (0, 0, 0), (1, 0, 1), (2, 0, 0)]
    assert [form["nas", i] for i in range(4)] == [(0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert hosts.form(logs, Query(since=100, until=100), 0).count() == 1
    counts = entries([(t, "a", 6, "m") for t in (5999, 6000, 6999, 9000, 9999, 10000)] + [(7500, "b", 6, "m")])
    found = {(r.host, r.window): r.n for r in hosts.window_counts(counts, 10_500, 1000, 4).collect()}
    assert [found["a", i] for i in range(4)] == [2, 0, 0, 2] and [found["b", i] for i in range(4)] == [0, 1, 0, 0]


def test_top_and_fields(entries):
    rows = [(i, "fw", 4, "m", {"src": s, "act": "block"}) for i, s in enumerate(["10.0.0.1"] * 3 + ["10.0.0.2"] * 2 + ["10.0.0.3"])]
    rows += [(7, "nas", 3, "m"), (8, "nas", 6, "m", {"src": "10.0.0.9", "act": "block"})]
    logs = entries(rows).cache()
    assert [tuple(r) for r in top.top(logs, Query(), "src", 2).collect()] == [("10.0.0.1", 3), ("10.0.0.2", 2)]
    assert tuple(top.totals(logs, Query(), "src", 2).first()) == (8, 7, 4, 2)
    assert [r.value[-1] for r in top.top(logs, Query(), "src", 10).collect()] == list("1239")
    assert tuple(top.top(logs, Query(), "host").first()) == ("fw", 6) and tuple(top.top(logs, Query(), "severity").first()) == ("4", 6)
    assert tuple(top.totals(logs, Query(host="fw"), "src").first())[:3] == (6, 6, 3)
    assert tuple(top.totals(logs, Query(), "missing").first()) == (8, 0, 0, 0) and top.top(logs, Query(), "missing").count() == 0
    assert [tuple(r) for r in top.field_names(logs, Query()).collect()] == [("act", 7), ("src", 7)]
    assert [tuple(r) for r in top.field_names(logs, Query(host="nas")).collect()] == [("act", 1), ("src", 1)]


TEMPLATES = {
    "user 4312 logged in from 10.0.0.7:5514": "user <*> logged in from <*>",
    "GET /api/v1/items/42 took 12ms (status=200)": "GET <*> took <*> (status=<*>)",
    "session 3f2a-91 closed.": "session <*> closed.",
    "retry [3/5], giving up": "retry [<*>], giving up",
    "user=alice id=42": "user=alice id=<*>",
    'code="E42" ok': 'code="<*>" ok',
    "=7 =x": "<*> =x",
    "panic at 12\n  frame 1": "panic at <*>",
    "": "",
    " ".join(["w"] * 200): " ".join(["w"] * 48),
}


def test_templates(spark, entries):
    df = spark.createDataFrame([(k, v) for k, v in TEMPLATES.items()], "m string, want string")
    assert [r.m for r in df.where(template(F.col("m")) != F.col("want")).collect()] == []
    hints = spark.createDataFrame([("user <*> logged in from <*>", "user logged from"), ("<*> <*>", ""), ("a: b, connection_reset by peer", "connection_reset peer"), ("aaa bbb ccc ddd eee fff ggg", "aaa bbb ccc ddd eee fff")], "t string, want string")
    assert [r.t for r in hints.where(search_hint(F.col("t")) != F.col("want")).collect()] == []
    rows = [(0, "a", 6, "hello"), (20, "a", 6, "disk 1 full"), (60, "a", 6, "hello"), (70, "a", 6, "disk 9 full"), (80, "a", 6, "disk 3 full"), (90, "b", 3, "disk 7 full")]
    found = {r.template: r for r in patterns.patterns(entries(rows), Query(since=0, until=100)).collect()}
    d, h = found["disk <*> full"], found["hello"]
    assert (d["count"], d.previous, d.recent, d.hosts, d.severity, d.first_ts, d.last_ts, d.id, d.example, d.search) == (4, 1, 3, 2, "err", 20, 90, 6, "disk 7 full", "disk full")
    assert (h["count"], h.previous, h.recent, h.severity) == (2, 1, 1, "info")
    words = entries([(i, "a", 6, w) for i, w in enumerate("abcdefghij")])
    assert tuple(patterns.totals(words, Query(since=0, until=100), 3).first())[:3] == (10, 7, False)


def test_context_and_pages(entries):
    rows = [r for i in range(10) for r in ((i * 10, "pve", 6, f"pve {i}"), (i * 10 + 5, "nas", 6, f"nas {i}"))] + [(50, "pve", 3, "pve tie")]
    logs = entries(rows).cache()
    said = lambda df: [(r.side, r.message) for r in df.collect()]
    at = 11  # pve 5
    assert said(search.context(logs, at, 2)) == [("before", "pve 3"), ("before", "pve 4"), ("after", "pve tie"), ("after", "pve 6")]
    assert [m for _, m in said(search.context(logs, at, 2, same_host=False))] == ["pve 4", "nas 4", "pve tie", "nas 5"]
    assert said(search.context(logs, 1, 1)) == [("after", "pve 1")]
    assert search.context(logs, at, 0).count() == 0 and search.context(logs, 999, 2).count() == 0
    logs = entries([(i // 5, "h", 6, f"m{i}") for i in range(47)]).cache()
    q, seen, pages = Query(limit=10), [], 0
    while True:
        df, cursor = search.page(logs, q)
        seen += [r.message for r in df.collect()]
        pages += 1
        if cursor is None:
            break
        q = search.next_page(q, *parse_cursor(cursor))
    assert pages == 5 and len(set(seen)) == 47 and seen[0] == "m46" and seen[-1] == "m0"


METRICS = [(1000, "web1", 3, "m", None, "a"), (2000, "web1", 3, "m", None, "a"), (12000, "web1", 3, "m", None, "a"), (13000, "web1", 6, "m", None, "a"), (25000, "db1", 3, "m", None, "a")]


def test_logql_metrics(entries):
    logs = entries(METRICS).cache()
    points = lambda q, a, b, s: sorted((r["t"] // 1000, r["value"]) for r in metrics.matrix(logs, q, a * 1000, b * 1000, s * 1000).collect())
    assert points("sum(count_over_time({}[10s]))", 10, 30, 10) == [(10, 2), (20, 2), (30, 1)]
    assert points("sum(count_over_time({}[20s]))", 10, 30, 10) == [(10, 2), (20, 4), (30, 3)]
    assert points("sum(count_over_time({}[15s]))", 15, 25, 10) == [(15, 4), (25, 3)]
    assert points('sum(rate({host="web1"}[10s]))', 10, 20, 10) == [(10, 0.2), (20, 0.2)]
    levels = sorted((r.level, r["t"] // 1000, r["value"]) for r in metrics.matrix(logs, "sum by (level) (count_over_time({}[10s]))", 10_000, 30_000, 10_000).collect())
    assert levels == [("error", 10, 2), ("error", 20, 1), ("error", 30, 1), ("info", 20, 1)]
    assert metrics.matrix(logs, "count_over_time({}[30s])", 30_000, 30_000, 1000).count() == 3
    assert [tuple(r) for r in metrics.matrix(logs, "sum by (nothing) (count_over_time({}[30s]))", 30_000, 30_000, 1000).collect()] == [("", 30_000, 5)]
    with pytest.raises(logql.LogqlError, match="maximum resolution"):
        metrics.matrix(logs, "sum(rate({}[5m]))", 0, 100_000_000, 1000)
    instant = entries([(1000, "web1", 3, "m", None, "a"), (9000, "web1", 3, "m", None, "a"), (9500, "db1", 6, "m", None, "a")])
    q = 'sum by (host) (count_over_time({app="a"}[10s]))'
    assert sorted(tuple(r) for r in metrics.vector(instant, q, 10_000).collect()) == [("db1", 1), ("web1", 2)]
    assert sorted(tuple(r) for r in metrics.vector(instant, q, 11_100).collect()) == [("db1", 1), ("web1", 1)]


def test_logql_streams(entries):
    logs = entries([(1000, "web1", 3, "boom 1", None, "nginx"), (2000, "web1", 3, "boom 2", None, "nginx"), (3000, "web1", 6, "ok", None, "nginx"), (4000, "db1", 4, "slow", None, "")])
    first = metrics.streams(logs, "{}", 0, 10_000).first()
    assert (first.host, first.level, first.ts_ns, first.line) == ("db1", "warning", "4000000000", "slow")
    assert [r.line for r in metrics.streams(logs, '{host="web1", level="error"}', 0, 10_000).collect()] == ["boom 2", "boom 1"]
    assert [r.line for r in metrics.streams(logs, '{host="web1"}', 0, 10_000, 2, True).collect()] == ["boom 1", "boom 2"]
    assert metrics.series(logs, ['{host="web1"}', '{level="error"}'], 0, 10_000).count() == 2


@pytest.mark.parametrize("op,value,want", [("=", "warn", {4}), ("=", "info", {5, 6}), ("=", "critical", {0, 1, 2}), ("=", "fatal", {0}), ("=~", "error|warning", {3, 4}), ("!=", "debug", set(range(7)))])
def test_logql_levels(op, value, want):
    assert logql.level_set(op, value) == want


@pytest.mark.parametrize(
    "query",
    ["", "{", '{host}', '{host="a"', '{host=a}', '{host="a"} |', '{host="a"} | line_format "x"', '{host="a"} |= x', "sum(x)", 'topk(5, rate({}[5m]))', "rate({})", "rate({}[])", "rate({}[0s])", "rate({}[5x])", 'sum without (a) (rate({}[5m]))', "vector(x)", "vector(1) +", '{a="b"} extra', 'rate({}[5m]) > 1', "{}[5m", '{host="a}', "%", '{host>"a"}'],
)
def test_logql_refused(query):
    with pytest.raises(ValueError):
        logql.parse(query)


def test_logql_accepted():
    q = logql.applied(logql.parse('{host=~"a.*",level!="debug",} |= "x" | json | status >= 500 | json = "y" !~ `z\\d`'), Query())
    assert [(f.key, f.op, f.value) for f in q.fields] == [("status", ">=", "500"), ("json", "=", "y")]
    assert [f.op for f in q.lines] == ["|=", "!~"] and q.severities == list(range(7))
    assert logql.parse("vector(1) + vector(2) * vector(3)") == 9.0
    for bad in ('{} | f !~ "x"', '{} | level > "a"', '{} | host > "a"', "{} | duration > 1.5s", '{} | f =~ "("'):
        with pytest.raises(ValueError):
            logql.applied(logql.parse(bad), Query())


def test_traces(spark):
    a, b = "a" * 32, "b" * 32
    cols = "trace_id string, span_id string, parent_id string, name string, service string, host string, start_us long, duration_us long, status int"
    rows = [(a, "1", "", "GET /cart", "shop", "pve", 1_000_000, 300_000, 0), (a, "2", "1", "SELECT cart", "db", "pve", 1_050_000, 200_000, 2), (b, "3", "", "GET /health", "shop", "pve", 5_000_000, 1_000, 1)]
    spans = spark.createDataFrame(rows + rows[:1], cols)
    spans = traces.first_spans(spans).cache()
    assert spans.count() == 3
    page = traces.listed(spans, 0, 10_000).collect()
    assert [r.trace_id for r in page] == [b, a]
    r = page[1]
    assert (r.root_name, r.root_service, r.start_ms, r.duration_us, r.spans, r.errors, r.services) == ("GET /cart", "shop", 1000, 300_000, 2, 1, ["db", "shop"])
    ids = lambda **k: [x.trace_id for x in traces.listed(spans, 0, k.pop("until", 10_000), **k).collect()]
    assert ids(service="db") == [a] == ids(name="select") == ids(errors=True) == ids(min_us=100_000) == ids(until=2000)
    assert ids(limit=1) == [b] and ids(access=Access(["pve"], ["shop"])) == [b]
    assert traces.listed(spans, 1040, 2000).first().root_name == "GET /cart"
    assert [x.span_id for x in traces.detail(spans, a, Access(["pve"], ["db"])).collect()] == ["2"]


def test_retention(entries):
    rows = [(1, "fw1", 6, "m", None, "dnsmasq"), (2, "fw2", 6, "m", None, "kernel"), (3, "web1", 6, "m", None, "nginx"), (4, "web1", 3, "m", None, "nginx"), (5, "db1", 7, "m", None, "pg"), (6, "web2", 6, "m", None, "cron"), (7, "web2", 3, "m", None, "cron")]
    R = retention.Rule
    rules = [R(["fw*"], cutoff=100), R(["web1"], severities=[3]), R(apps=["cron"], cutoff=100), R(["web*"], cutoff=100)]
    kept, gone = retention.split(entries(rows), rules, {6: 100})
    assert times(kept) == [4, 5] and gone.count() == 5
    table = entries([(t, "h", s, "m") for t in (100, 900) for s in range(8)])
    assert retention.split(table, [], {7: 500, 6: 500, 3: 50})[1].count() == 2
    assert retention.split(table, [], {s: 950 for s in range(8)})[1].count() == 16
    assert retention.spans_cutoff({s: s for s in range(8)}) == 0 and retention.spans_cutoff({1: 5}) is None
    size = retention.size_of()
    logs = entries([(i * 1_000_000, "h", 6, "m" * 10) for i in range(50)])
    each = logs.select(size.alias("s")).first().s
    assert sorted(r.id for r in retention.within_size(logs, each * 40).collect()) == list(range(15, 51))
    assert retention.within_size(logs, each * 50).count() == 50


def test_scalars(spark):
    rows = [("5", 5.0), (" 1e1 ", 10.0), ("0.5s", None), ("5d", None), ("nan", None), ("inf", None), ("1e999", None), (".5", 0.5), ("5.", 5.0), ("+1", 1.0), ("1_0", None), ("", None), ("0x1", None)]
    df = spark.createDataFrame(rows, "t string, want double")
    assert [r.t for r in df.where(~number(F.col("t")).eqNullSafe(F.col("want"))).collect()] == []
    cut = spark.createDataFrame([("abcdef", "abcd"), ("äöü", "äö"), ("a日本", "a日"), ("ab😀", "ab"), ("abc", "abc")], "t string, want string")
    assert [r.t for r in cut.where(truncated(F.col("t"), 4) != F.col("want")).collect()] == []


def test_regex_translation():
    assert Regex(r"(?P<a_b>\d+)$").java == r"(?U)(\d+)\z" and Regex("(?P<a>x)(y)").names == ["a", None]
    for bad in ("(", "a(?=b)", "(?<!a)b", r"(a)\1", "a++", "[", ")", "a" * 501, "(?>a)", r"\K"):
        with pytest.raises(ValueError):
            Regex(bad)


def test_hostile_text_is_refused_or_planned(entries):
    """Whatever users type gives a ValueError or a plan."""
    rng, logs = random.Random(9), entries(TEXTS)
    alphabet = 'ab"*-OR NOT(){}[]|\\~=!<>.$^?+%\'`\n\té,:1'
    for _ in range(300):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        text.parse(s)
        for make in (lambda s=s: parse_expression(s), lambda s=s: logql.parse(s), lambda s=s: Regex(s), lambda s=s: durations.duration_ms(s)):
            try:
                make()
            except ValueError:
                pass
    for s in ('"', "a* OR", "NOT", "é -", "(((", "%_", "a\0b", '"a"*'):
        logs.where(predicate(Query(q=s))).count()
