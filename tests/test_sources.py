"""Decoders, enrichment, sinks and the catalog: known inputs, round trips and hostile bytes."""

import gzip
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumberline import catalog
from lumberline.functions import messages, parsers
from lumberline.functions.rules import Drop, Mask, applied
from lumberline.functions.structured import enriched, extract
from lumberline.functions.traces import with_trace_ids
from lumberline.operators import maintenance
from lumberline.sinks import export, forward
from lumberline.sources import cef, decoders, syslog, wire, zones


def test_structured():
    assert extract('level=info msg="user logged in" user=bob took=12ms') == {"level": "info", "msg": "user logged in", "user": "bob", "took": "12ms"}
    assert extract(r'a="say \"hi\"" b=2') == {"a": 'say "hi"', "b": "2"} and extract('a=1 b="open')["b"] == "open"
    assert list(extract("a=1 b= c=3")) == ["a", "c"] and len(extract("sshd a=1 b=2")) == 2
    for plain in ("disk error on sda", "user=bob logged in from the office today", "see http://x/?a=1&b=2 in a sentence", "x = y", "1=2 3=4", " ", "[1,2,3]", "{broken json"):
        assert extract(plain) == {}, plain
    nested = extract('{"http":{"method":"GET","status":200},"level":"warn","msg":"slow","ok":true,"a":{"b":{"c":{"d":1}}},"n":null,"e":"","l":[1]}')
    assert nested == {"http.method": "GET", "http.status": "200", "level": "warn", "msg": "slow", "ok": "true"}
    assert extract('{"user name":"x"}') == {"user_name": "x"}
    assert len(extract(" ".join(f"k{i}=v" for i in range(200)))) == 64 and len(extract(f"a={'x' * 5000} b=1")["a"]) == 1024
    assert extract("a=1 b=" + "x" * 70_000) == {} and extract("a=1 b=2\n  at frame one\n  at frame two of it") == {"a": "1", "b": "2"}


def test_enriched(spark):
    df = spark.createDataFrame([("a=1 b=2", None), ("a=1 b=2", {"a": "x"}), ("plain", None)], "message string, fields map<string,string>")
    assert [r.f for r in df.select(enriched(F.col("message"), F.col("fields")).alias("f")).collect()] == [{"a": "1", "b": "2"}, {"a": "x"}, None]
    assert [r.f for r in df.select(enriched(F.col("message"), F.col("fields"), True).alias("f")).collect()] == [{"a": "1", "b": "2"}, {"a": "x", "b": "2"}, {}]


def test_trace_ids(spark):
    t, s = "4BF92F3577B34DA6A3CE929D0E0E4736", "00F067AA0BA902B7"
    rows = [{"traceId": t}, {"trace_id": f' "{t}" '}, {"traceparent": f"00-{t}-{s}-01"}, {"traceparent": f"00-{'0' * 32}-{s}-01"}, {"other": "x"}, {"X-Trace-Id": "opaque Z"}]
    got = [r.f for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f map<string,string>").select("i", with_trace_ids(F.col("f")).alias("f")).orderBy("i").collect()]
    assert [g.get("trace_id") for g in got] == [t.lower()] * 3 + [None, None, "opaque Z"]
    assert got[2]["span_id"] == s.lower() and got[0]["traceId"] == t


NOW = 1_791_028_800_000  # 2026-10-03T12:00:00Z


def lines(spark, *texts, zone="reception", now=NOW):
    df = spark.createDataFrame([(i, t, "10.1.1.1", now) for i, t in enumerate(texts)], "i int, line string, peer string, arrival long")
    return [(r.ts, r.host, r.app, r.severity, r.message) for r in syslog.entries(df.orderBy("i"), zone).collect()]


def test_syslog(spark):
    got = lines(
        spark,
        "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su 123 ID47 - 'su root' failed",
        "<14>1 - - - - - - hello\n",
        '<165>1 2003-10-11T22:14:15Z h app 1 ID [a b="x\\"]" c="]"][d] ﻿after',
        "<14>1 - h a - - [open x=\"1\" text",
        "<13>Oct  3 11:59:58 web1 sshd[77]: Accepted key",
        "<13>Oct  3 11:59:58 web1 no tag here",
        "just text",
        "<999>odd",
        "<14>1 2003-10-11T22:14:15Z h app 1 ID",
        "kernel: oops",
    )
    assert got == [
        (1065910455003, "mymachine.example.com", "su", 2, "'su root' failed"),
        (NOW, "10.1.1.1", "", 6, "hello"),
        (1065910455000, "h", "app", 5, "after"),
        (NOW, "h", "a", 6, '[open x="1" text'),
        (NOW, "web1", "sshd", 5, "Accepted key"),
        (NOW, "web1", "", 5, "no tag here"),
        (NOW, "10.1.1.1", "", 6, "just text"),
        (NOW, "10.1.1.1", "", 6, "<999>odd"),
        (NOW, "10.1.1.1", "kernel", 6, "oops"),
    ]
    line = "<13>Oct  3 11:59:58 web1 a: m"
    assert lines(spark, line, zone="utc")[0][0] == NOW - 2000 and lines(spark, line, zone="+02:00")[0][0] == NOW - 7_202_000
    assert lines(spark, line, zone="Europe/Paris")[0][0] == NOW - 7_202_000 == lines(spark, line, zone="CET-1CEST,M3.5.0,M10.5.0/3")[0][0]
    assert lines(spark, "<13>Dec 31 23:00:00 h a: m", zone="utc")[0][0] == 1767222000000  # last year's
    assert lines(spark, "<13>Feb 30 23:00:00 h a: m", zone="utc")[0][0] == NOW


def test_zones():
    rule = zones.Rule("CET-1CEST,M3.5.0,M10.5.0/3")
    wall = lambda m, d, h, mi=0: (__import__("datetime").datetime(2026, m, d, h, mi) - __import__("datetime").datetime(1970, 1, 1)).total_seconds()
    assert rule.to_ms(int(wall(7, 1, 12)), 2026) == int(wall(7, 1, 10)) * 1000
    assert rule.to_ms(int(wall(1, 1, 12)), 2026) == int(wall(1, 1, 11)) * 1000
    assert rule.to_ms(int(wall(10, 25, 2, 30)), 2026) == int(wall(10, 25, 0, 30)) * 1000  # twice: the earlier
    assert rule.to_ms(int(wall(3, 29, 2, 30)), 2026) is None  # skipped
    south = zones.Rule("AEST-10AEDT,M10.1.0,M4.1.0/3")
    assert south.to_ms(int(wall(1, 1, 12)), 2026) == int(wall(1, 1, 1)) * 1000
    for bad in ("+99:00", "No/Such", "X", "CET-1CEST,M3", "+1:2:3"):
        with pytest.raises(ValueError):
            zones.parse(bad)


def test_cef(spark):
    header, ext = cef.parse(r"CEF:0|Ven\|dor|Prod\\uct|1|2|Na\|me|5|msg=a\=b\\c\nline src=1.2.3.4")
    assert header[1:3] == ["Ven|dor", r"Prod\uct"] and dict(ext) == {"msg": "a=b\\c\nline", "src": "1.2.3.4"}
    assert cef.extension("k1= k2=v w x k3=y") == [("k1", ""), ("k2", "v w x"), ("k3", "y")]
    for bad in ("CEF:0|a|b|c", "CEF:x|a|b|c|d|e|5|", "CEF 0|a|b|c|d|e|5|"):
        assert cef.parse(bad) is None
    df = spark.createDataFrame([(5, "fw", "CEF", 6, "0|V|P|1|9|Drop|5|msg=bad act=block UNIFIutcTime=2026-10-03T12:00:00.500Z", None), (5, "h", "x", 6, "plain CEF: no", None)], "ts long, host string, app string, severity int, message string, fields map<string,string>")
    a, b = sorted(cef.enriched(df).collect(), key=lambda r: r.app == "x")
    assert (a.ts, a.app, a.message, a.fields["act"], a.fields["cef_name"]) == (NOW + 500, "P", "Drop: bad", "block", "Drop") and (b.message, b.fields) == ("plain CEF: no", None)


def test_native_json(spark):
    body = b'{"message":"upstream timeout","host":"web1","severity":3,"ts":5,"fields":{"status":504,"ok":true,"b d":1,"n":null}}\nnot json\n\n{"MESSAGE":"boot","_HOSTNAME":"pve","PRIORITY":"4","__REALTIME_TIMESTAMP":"1700000000000000","_COMM":"systemd"}\n{"message":""}'
    df = spark.createDataFrame([(body, 7)], "body binary, arrival long")
    rows = decoders.decoded(df, "json").collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) == 4 and [(r.ts, r.host, r.app, r.severity, r.message, r.fields) for r in good] == [(5, "web1", "", 3, "upstream timeout", {"ok": "true", "status": "504"}), (1700000000000, "pve", "systemd", 4, "boot", None)]
    assert [r.error for r in decoders.decoded(spark.createDataFrame([(b'[{"message":"a"},', 7)], "body binary, arrival long"), "json").collect()] == ["invalid JSON"]
    assert decoders.decoded(spark.createDataFrame([(gzip.compress(b'[{"message":"a"},{"message":"b"}]'), 7)], "body binary, arrival long"), "json").count() == 2


def test_gelf():
    one = lambda v, **k: decoders.gelf(json.dumps({"short_message": "s", **v}).encode(), 9)[0]
    assert one({"full_message": "s\nmore", "host": "h", "level": 3, "timestamp": 1.5, "_app": "web", "_id": 1, "_user": "bob", "_n": 2.5}) == (1500, "h", "web", 3, "s\ns\nmore", {"n": "2.5", "user": "bob"}, None)
    assert one({"timestamp": 1.7e12, "level": 9})[:4] == (1_700_000_000_000, "unknown", "", 6)
    assert decoders.gelf(zlib.compress(b'{"short_message":"z"}'), 1)[0][4] == "z"
    for bad in (b"", b"[]", b'{"short_message":""}', b"\x1e\x0fxx", b"\x1f\x8bxx"):
        with pytest.raises(wire.Malformed):
            decoders.gelf(bad, 0)
    assert wire.gelf_frames(b"a\0b\n\n\0c") == [b"a", b"b", b"c"]


def field(n, raw):
    return bytes([n << 3 | 2]) + varint(len(raw)) + raw


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def literal(raw):
    """A Snappy block of literals."""
    out = varint(len(raw))
    for i in range(0, len(raw), 60):
        part = raw[i : i + 60]
        out += bytes([len(part) - 1 << 2]) + part
    return out


def test_loki():
    push = {"streams": [{"stream": {"host": "web1", "job": "nginx", "level": "error", "env": "prod"}, "values": [["1500000000", "a=1 b=2", {"trace": "t"}], ["x", "plain"]]}]}
    want = [(1500, "web1", "nginx", 3, "a=1 b=2", {"a": "1", "b": "2", "env": "prod", "trace": "t"}, None), (9, "web1", "nginx", 3, "plain", {"env": "prod"}, None)]
    assert decoders.loki_json(json.dumps(push).encode(), 9) == want
    stamp = lambda s, ns: field(1, b"\x08" + varint(s) + b"\x10" + varint(ns))
    pair = field(3, field(1, b"trace") + field(2, b"t"))
    stream = field(1, b'{host="web1", job="nginx", level="error", env="prod"}') + field(2, stamp(1, 500_000_000) + field(2, b"a=1 b=2") + pair) + field(2, field(2, b"plain"))
    assert decoders.loki_protobuf(literal(field(1, stream)), 9) == want
    assert decoders.loki_labels(r'{a="x,\"y\"", b=z, =, c="\n"}') == [("a", 'x,"y"'), ("b", "z"), ("c", "\n")]
    for bad in (b"{}", b"[]", b'{"streams":[{"values":[["1"]]}]}', b'{"streams":[{"values":[["1",2]]}]}'):
        with pytest.raises(wire.Malformed):
            decoders.loki_json(bad, 0)


def test_snappy_copies():
    block = varint(11) + bytes([2 << 2]) + b"abc" + bytes([4 - 4 << 2 | 1, 3]) + bytes([4 - 1 << 2 | 2, 7, 0])
    assert wire.unsnapped(block) == b"abcabcaabca"
    for bad in (b"", varint(5) + bytes([2 << 2]) + b"ab", varint(4) + bytes([1, 9]), varint(1 << 30), varint(9) + b"\x00a"):
        with pytest.raises(wire.Malformed):
            wire.unsnapped(bad)


def test_otlp():
    text = lambda s: {"stringValue": s}
    attrs = lambda d: [{"key": k, "value": v} for k, v in d.items()]
    resource = {"attributes": attrs({"host.name": text("h"), "service.name": text("shop"), "env": text("prod")})}
    log = {"timeUnixNano": "1500000000", "severityNumber": 17, "body": text("took=3 a=b"), "attributes": attrs({"n": {"intValue": "7"}, "l": {"arrayValue": {"values": [text("x")]}}}), "traceId": "ab" * 16, "spanId": "0" * 16}
    body = json.dumps({"resourceLogs": [{"resource": resource, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [log, {}]}]}]}).encode()
    got = decoders.otlp_logs_json(body, 9)
    assert got[0] == (1500, "h", "shop", 3, "took=3 a=b", {"took": "3", "a": "b", "env": "prod", "scope": "lib", "n": "7", "l": '["x"]', "trace_id": "ab" * 16}, None)
    assert got[1][:5] == (9, "h", "shop", 6, "(no message)")
    kv = lambda k, v: field(1, k) + field(2, field(1, v))
    fixed = lambda n, v: bytes([n << 3 | 1]) + struct.pack("<Q", v)
    record = fixed(1, 1_500_000_000) + b"\x10" + varint(17) + field(5, field(1, b"took=3 a=b")) + field(6, field(1, b"n") + field(2, b"\x18\x07")) + field(9, bytes.fromhex("ab" * 16))
    proto = field(1, field(1, field(1, kv(b"host.name", b"h")) + field(1, kv(b"service.name", b"shop"))) + field(2, field(1, field(1, b"lib")) + field(2, record)))
    assert decoders.otlp_logs_protobuf(proto, 9)[0] == (1500, "h", "shop", 3, "took=3 a=b", {"took": "3", "a": "b", "scope": "lib", "n": "7", "trace_id": "ab" * 16}, None)
    frame = lambda m, packed=0: struct.pack(">BI", packed, len(m)) + m
    calls = frame(proto) + frame(gzip.compress(proto), 1) + frame(b"")
    assert decoders.otlp_logs_grpc(calls, 9) == decoders.otlp_logs_protobuf(proto, 9) * 2 and decoders.otlp_logs_grpc(b"", 9) == []
    for wrong in (frame(proto)[:-1], frame(proto)[:3], frame(proto, 2), frame(gzip.compress(proto)[:-4], 1)):
        with pytest.raises(wire.Malformed):
            wire.grpc_messages(wrong)
    span = {"traceId": "AB" * 16, "spanId": "cd" * 8, "name": "GET", "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": "5000000", "endTimeUnixNano": "4000000", "status": {"code": "STATUS_CODE_ERROR", "message": "m"}, "events": [{"timeUnixNano": "6000", "name": "e"}]}
    body = json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [span, {"traceId": "0" * 32, "spanId": "cd" * 8}]}]}]}).encode()
    good, bad = decoders.otlp_spans_json(body, 0)
    assert good[:11] == ("ab" * 16, "cd" * 8, "", "GET", 2, "shop", "h", 5000, 0, 2, "m") and json.loads(good[12]) == [{"ts_us": 6, "name": "e"}] and bad[13]
    raw = field(1, bytes.fromhex("ab" * 16)) + field(2, bytes.fromhex("cd" * 8)) + field(5, b"GET") + b"\x30\x02" + fixed(7, 5_000_000) + fixed(8, 9_000_000) + field(15, b"\x18\x02" + field(2, b"m"))
    proto = field(1, field(2, field(2, raw)))
    assert decoders.otlp_spans_protobuf(proto, 0)[0][:11] == ("ab" * 16, "cd" * 8, "", "GET", 2, "", "unknown", 5000, 4000, 2, "m")


def test_hostile_bytes():
    rng = random.Random(8)
    seeds = [b'{"message":"a","fields":{"a":{}}}', b'{"streams":[{"stream":{"a":1},"values":[["1","x"]]}]}', literal(field(1, field(1, b'{a="b"}'))), field(1, field(2, field(2, b"\x09" + b"\0" * 8))), b'{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"kvlistValue":{"values":[]}}}]}]}]}']
    for _ in range(1500):
        raw = bytearray(rng.choice(seeds))
        for _ in range(rng.randrange(6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        raw = bytes(raw[: rng.randrange(len(raw) + 1)])
        for decode in {*decoders.ENTRY_FORMATS.values(), *decoders.SPAN_FORMATS.values()}:
            try:
                decode(raw, 0)
            except (wire.Malformed, UnicodeDecodeError):
                pass
        wire.syslog_frames(raw)
        cef.read("CEF", wire.text(raw))


def test_framing_and_bodies():
    assert wire.syslog_frames(b"5 <1>ab<2>line\r\n\n12 monkeys\n<3>last") == (["<1>ab", "<2>line", "12 monkeys", "<3>last"], b"")
    assert wire.syslog_frames(b"<1>a\n9 <1>ab", last=False) == (["<1>a"], b"9 <1>ab") and wire.syslog_frames(b"<1>a\n12", last=False)[1] == b"12"
    assert wire.inflated(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and wire.inflated(zlib.compress(b"z")) == b"z" and wire.inflated(b"plain") == b"plain"
    with pytest.raises(wire.Malformed):
        wire.inflated(gzip.compress(b"0" * 5000), 100)


def test_rules(entries):
    logs = entries([(1, "router", 6, "login password=hunter2 from 10.1.2.3 and 10.9.9.9", {"ip": "10.0.0.1"}), (2, "pc", 6, "from 10.1.2.3")])
    rules = [Mask(r"(token|password)=\S+", "$1=[hidden]"), Mask(r"\d+\.\d+\.\d+\.\d+", "***", hosts=["router"])]
    got = {r.ts: (r.message, r.fields) for r in applied(logs, rules).collect()}
    assert got[1] == ("login password=[hidden] from *** and ***", {"ip": "***"}) and got[2][0] == "from 10.1.2.3"
    assert applied(entries([(1, "h", 6, "a secret here")]), [Mask("secret", "***"), Drop(r"\*\*\*")]).count() == 0
    assert [r.severity for r in applied(entries([(1, "h", s, "m", None, "cron") for s in (3, 6, 7)]), [Drop(apps=["cron"], severities=[6, 7])]).collect()] == [3]
    assert applied(entries([(1, "h", 6, "a1")]), [Mask(r"(?P<x>\d)", "$$${x}")]).first().message == "a$1"


def test_parsers(entries):
    access = parsers.Parser(r'^(?P<remote>\S+) \S+ \S+ \[(?P<time>[^\]]+)\] "(?P<method>\S+) (?P<path>\S+)[^"]*" (?P<status>\d+) (?P<bytes>\S+)$', "access", timestamp_from="time", timestamp_format="%d/%b/%Y:%H:%M:%S %z")
    level = parsers.Parser(r"^\[(?P<lvl>\w+)\] (?P<who>\S+): (?P<msg>.*)$", "level", level_from="lvl", host_from="who", message_from="msg", keep_generic=True)
    logs = entries([(1, "h", 6, '10.0.0.7 - - [03/Oct/2026:12:00:00 +0200] "GET /api/x?y=1 HTTP/1.1" 502 -'), (2, "h", 6, "[ERROR] web9: a=1 b=2"), (3, "h", 6, "x=1 y=2")])
    got = sorted(parsers.applied(logs, [access, level]).collect(), key=lambda r: r.id)
    assert got[0].ts == 1791021600000 and {k: got[0].fields[k] for k in ("remote", "method", "path", "status", "bytes")} == {"remote": "10.0.0.7", "method": "GET", "path": "/api/x?y=1", "status": "502", "bytes": "-"}
    assert (got[1].severity, got[1].host, got[1].message, got[1].fields["a"], got[1].fields["lvl"]) == (3, "web9", "a=1 b=2", "1", "ERROR")
    assert got[2].fields == {"x": "1", "y": "2"}
    for bad in ({"regex": "no groups"}, {"regex": "(?P<a>x)", "level_from": "b"}, {"regex": "(?P<a>x)", "timestamp_from": "a"}, {"regex": "(?P<a>x)", "timestamp_from": "a", "timestamp_format": "%Q"}):
        with pytest.raises(ValueError):
            parsers.Parser(**bad)


def test_maintenance(spark):
    windows = [maintenance.Once(["a*"], 100, 200, "upgrade"), maintenance.Weekly([], 1380, 60, "", [6])]
    day = 86_400_000
    saturday = 2 * day  # 1970-01-03
    rows = [(150, "a1"), (150, "b"), (200, "a1"), (saturday + 1385 * 60_000, "b"), (saturday + day + 30 * 60_000, "b"), (saturday + 30 * 60_000, "b")]
    got = [r.m for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ts long, host string").orderBy("i").select(maintenance.reason(F.col("host"), F.col("ts"), windows).alias("m")).collect()]
    assert got == ["upgrade", None, None, "maintenance", "maintenance", None]
    alerts = spark.createDataFrame([(150, "r1", "a1"), (150, "r2", "a1"), (150, "r2", "b")], "ts long, rule string, host string")
    assert [r.muted for r in maintenance.muted(alerts, {"r1": (1000, "")}, windows).collect()] == ["muted", "upgrade", None]


def test_export_round_trip(spark, entries, tmp_path):
    logs = entries([(NOW, "h,1", 3, 'say "hi"\nthere', {"b": "2", "a": "1"}), (NOW + 86_400_000, "h2", 6, "plain", None, "")])
    line = [r.v for r in logs.orderBy("id").select(export.csv_line().alias("v")).collect()]
    assert line[0] == f'1,{NOW},2026-10-03T12:00:00.000Z,"h,1",app,3,"say ""hi""\nthere","{{""a"":""1"",""b"":""2""}}"' and line[1].endswith("plain,")
    assert json.loads(logs.select(export.ndjson().alias("v")).orderBy("id").first().v) == {"id": 1, "ts": NOW, "host": "h,1", "app": "app", "severity": 3, "message": 'say "hi"\nthere', "fields": {"a": "1", "b": "2"}}
    assert logs.where("id = 2").select(export.terminal_line().alias("v")).first().v == "2026-10-04T12:00:00.000Z h2 - info plain"
    syslog_line = logs.where("id = 1").select(export.rfc5424().alias("v")).first().v
    assert syslog_line.startswith('<11>1 2026-10-03T12:00:00.000Z h,1 app - - [fields@32473 a="1" b="2"] say')
    back = syslog.entries(spark.createDataFrame([(syslog_line, "p", 0)], "line string, peer string, arrival long")).first()
    assert (back.ts, back.host, back.app, back.severity, back.message) == (NOW, "h,1", "app", 3, 'say "hi"\nthere')
    export.write_archive(logs, str(tmp_path / "a"))
    same = export.read_archive(spark, str(tmp_path / "a"))
    assert sorted((r.ts, r.host, r.app, r.message, r.fields) for r in same.collect()) == [(NOW, "h,1", "app", 'say "hi"\nthere', {"a": "1", "b": "2"}), (NOW + 86_400_000, "h2", "", "plain", None)]
    assert export.read_archive(spark, str(tmp_path / "a"), "2026-10-04").count() == 1
    export.write_export(logs, str(tmp_path / "c"), "csv")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*"))).count(b"\r\n") == 2
    assert export.backup(logs, str(tmp_path / "b"))["rows"] == 2 and export.oldest_backups(["b3", "b1", "b2"], 2) == ["b1"]


def test_forward_and_notices(spark, entries):
    logs = entries([(i, "h", 6, f"m{i}") for i in range(5)])
    told = forward.sent(logs.coalesce(1).select(export.ndjson(False).alias("value")), "http://x", size=2, send=lambda url, body, head: 200)
    assert [tuple(r) for r in told.collect()] == [(2, True), (2, True), (1, True)]
    answers = iter([503, 429, 200])
    assert forward.delivered(lambda: next(answers), wait=lambda s: None) and not forward.delivered(lambda: 400) and not forward.delivered(lambda: 500, 2, lambda s: None)
    rows = [("silent", "h", None, 0, 0, 130, 60, ""), ("alert", None, "r", 3, 0, 60, 0, "x\ny"), ("volume_drop", "h", None, 5, 100, 7300, 0, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, host string, rule string, n int, usual int, secs int, limit int, sample string")
    c = [F.col(x) for x in ("kind", "host", "rule", "n", "usual", "secs", "limit", "sample")]
    assert [r.m for r in df.orderBy("i").select(messages.message(*c).alias("m")).collect()] == ["No logs from h for 2m (threshold 60s)", "Alert r: 3 matching entries within 60s. Last: x y", "h sent 5 entries in 2h1m, far below its usual 100"]
    body = df.limit(1).select(messages.rendered("slack", F.lit("silent"), F.lit("<!a> & b"), F.lit("{}")).alias("s"), messages.rendered("discord", F.lit("silent"), F.lit("t"), F.lit("{}")).alias("d")).first()
    assert json.loads(body.s) == {"text": "&lt;!a&gt; &amp; b"} and json.loads(body.d) == {"content": "t", "allowed_mentions": {"parse": []}}
    text = forward.prometheus(spark.createDataFrame([('a"b', 2), ("c", 1)], "host string, count long"), "n_total", "Help", ["host"]).first().text
    assert text == '# HELP n_total Help\n# TYPE n_total counter\nn_total{host="a\\"b"} 2\nn_total{host="c"} 1\n'

    class Server:
        sent = []

        def __init__(self, *a):
            pass

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def send_message(self, m):
            self.sent.append(m["Subject"])

    mail = forward.Mailer("h", 25, "a@example.org", ["b@example.org"], 2, ["silent"], Server)
    assert [mail.send(k, "s\nt", "x", t) for k, t in (("silent", 0), ("new", 0), ("silent", 1), ("silent", 2), ("silent", 3_600_000))] == [True, None, True, None, True]


def test_catalog(spark, tmp_path):
    views = catalog.Views(str(tmp_path / "v.json"))
    a, b = views.save("Beta", {"q": "x"}), views.save("alpha", {"host": "h"})
    assert views.save("Beta", {"q": "y"}) == a and [r["name"] for r in catalog.Views(str(tmp_path / "v.json")).listed()] == ["alpha", "Beta"]
    assert views.remove(b) and not views.remove(99)
    for bad in (("", {}), ("n", {"zz": "1"}), ("n", {"q": "x" * 501}), ("x" * 81, {})):
        with pytest.raises(ValueError):
            views.save(*bad)
    rules = catalog.AlertRules()
    rules.save("r", {"count": 3, "window_secs": 60, "pattern": "x"})
    rules.rows.append({"id": 9, "name": "broken", "value": {"count": 0, "window_secs": 1, "pattern": "("}})
    assert [n for n, _ in rules.usable()] == ["r"]
    m = catalog.Maintenance()
    one = m.add(["h"], 10, 0, "t")
    assert m.add([], 5, 11 * 60_000) == one + 1 and [i for i, _ in m.listed(11 * 60_000)] == [one + 1] and m.remove(one + 1)
    mutes = catalog.Mutes()
    mutes.set("r", 1, 0)
    assert mutes.listed(59_999) and not mutes.listed(60_000) and mutes.clear("r") and not mutes.clear("r")
    rows = [(1, 1, "t", "GET", "/api/logs", 200), (2, 2, "u", "POST", "/ingest", 200), (3, 3, "t", "POST", "/ingest", 403), (4, 4, "t", "DELETE", "/api/views/1", 200), (5, 5, "t", "GET", "/api/stats", 200)]
    audit = spark.createDataFrame(rows, "id long, ts long, token string, method string, path string, status int")
    assert sorted(r.id for r in audit.where(catalog.audit_wanted(F.col("method"), F.col("path"), F.col("status"))).collect()) == [1, 3, 4]
    assert [r.id for r in catalog.audit_history(audit, token="t", since=2).collect()] == [5, 4, 3] and [r.id for r in catalog.audit_history(audit, refused=True).collect()] == [3]
    alerts = audit.select("id", "ts", F.lit("silent").alias("kind"), F.col("token").alias("host"))
    assert [r.id for r in catalog.alert_history(alerts, kind="silent", host="u").collect()] == [2] and catalog.purged(alerts, 86_400_003, 1).count() == 3


def test_streams_and_chunks(spark):
    from lumberline.sources import files

    df = spark.createDataFrame([("p", b"5 <1>ab<2>line\n<3>last", 7)], "peer string, body binary, arrival long")
    assert [r.line for r in files.syslog_lines(df).collect()] == ["<1>ab", "<2>line", "<3>last"]
    whole = b'{"short_message":"joined"}'
    head = lambda i: b"\x1e\x0f12345678" + bytes([i, 2])
    grams = [("p", head(1) + whole[9:], 2), ("p", head(0) + whole[:9], 1), ("q", whole, 3), ("q", head(0) + b"x", 4)]
    plain, chunks = files.gelf_datagrams(spark.createDataFrame(grams, "peer string, body binary, arrival long"))
    bodies = plain.unionByName(files.joined_chunks(chunks))
    assert [r.message for r in decoders.decoded(bodies, "gelf").collect()] == ["joined", "joined"]
    assert [bytes(r.body) for r in files.gelf_bodies(spark.createDataFrame([("p", b"a\0b\n", 1)], "peer string, body binary, arrival long")).collect()] == [b"a", b"b"]


def test_traceparent_with_more_parts(spark):
    from lumberline.functions.traces import normalized_id, with_trace_ids

    t, s = "Ab" * 16, "c1" * 8
    rows = [f"00-{t}-{s}-00-extra", f"00-{t}-{s}-00", f"00-{'0' * 32}-{s}-01", f"00-{t}-{'0' * 16}-01", f"00-{t}-{s}"]
    df = spark.createDataFrame([(i, {"TraceParent": v}) for i, v in enumerate(rows)], "id int, fields map<string,string>")
    got = {r.id: (r.f.get("trace_id"), r.f.get("span_id")) for r in df.select("id", with_trace_ids(F.col("fields")).alias("f")).collect()}
    assert [got[i] for i in range(5)] == [(t.lower(), s)] * 2 + [(None, None)] * 3
    assert normalized_id(' "ABC" ') == "abc" and normalized_id("x Y") == "x Y"
    for bad in ("", '"', "a\x01b", "z" * 129):
        with pytest.raises(ValueError):
            normalized_id(bad)
