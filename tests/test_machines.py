"""State machines: known sequences, and the same rows in batch and as a stream."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lumberline.streaming import batch, live
from lumberline.streaming.machines import BothLimits, Chunks, Dedup, Multiline, PatternAlert, PerMinute, Quota, RateLimit, Silence, Volume, Watch


def play(machine, rows, until=None):
    """Outputs of rows (arrival, values) of one key."""
    state, out = None, []
    for row in rows:
        while state is not None and (at := machine.due(state)) is not None and at <= row["arrival"]:
            new, told = machine.tick(state, at)
            out += told
            if new == state:
                break
            state = new
        state, told = machine.step(json.loads(json.dumps(state)), row)
        out += told
    while until is not None and state is not None and (at := machine.due(state)) is not None and at <= until:
        state, told = machine.tick(state, at)
        out += told
    return out


def entry(t, message="link down"):
    return {"arrival": t, "ts": t, "host": "h", "app": "a", "severity": 6, "message": message}


def test_dedup():
    m = Dedup(10_000)
    out = play(m, [entry(t) for t in (0, 1000, 2000, 5000)])
    assert [x[4] for x in out] == ["link down"]
    out = play(m, [entry(t) for t in (0, 1000, 2000, 5000)], 10_000)
    assert out[1][0] == 5000 and out[1][4:] == ("link down [repeated 3 more times over 5s]", 3)
    out = play(m, [entry(t, "tick") for t in (0, 1000, 12_000)])
    assert [x[4] for x in out] == ["tick", "tick [repeated 1 more times over 1s]", "tick"]
    assert len(play(m, [entry(0, "x" * 3000), entry(1, "x" * 3000)])) == 2
    assert len(play(m, [entry(5000), entry(1000)])) == 2  # the clock went back


def test_pattern_alert():
    rows = lambda ts: [{"arrival": t * 1000, "host": "h", "message": "m"} for t in ts]
    fired = lambda m, ts: [x[0] // 1000 for x in play(m, rows(ts))]
    assert fired(PatternAlert("r", 3, 60_000, 60_000), [0, 10, 20, 30, 40, 50, 81, 82, 83, 1000]) == [20, 81]
    assert fired(PatternAlert("r", 3, 10_000, 60_000), [*range(0, 40, 6)]) == []
    assert fired(PatternAlert("r", 3, 10_000, 60_000), [0, 20, 40, 41, 42]) == [42]


def test_silence():
    m = Silence(60_000)
    out = play(m, [{"arrival": 0, "host": "h"}, {"arrival": 100_000, "host": "h"}])
    assert [(x[0], x[1], x[3]) for x in out] == [(60_001, "silent", 60_001), (100_000, "recovered", 0)]
    assert play(m, [{"arrival": 0, "host": "h"}], 60_000) == []
    assert play(Silence(60_000, {"h": 0}), [{"arrival": 0, "host": "h"}], 10**9) == []


def windows(counts):
    return [{"arrival": i, "number": i, "n": n, "host": "h"} for i, n in enumerate(counts)]


def test_volume():
    m = Volume(300_000, 4, 10, 3.0, 0.2, 600_000)
    assert [(x[1], x[3], x[4]) for x in play(m, windows([100] * 4 + [700, 700, 100, 100, 5]))] == [("surge", 700, 100), ("drop", 5, 100)]
    assert [(x[1], x[3], x[4]) for x in play(m, windows([50] * 4 + [0]))] == [("drop", 0, 50)]
    assert play(m, windows([4] * 4 + [40])) == [] and play(m, windows([100] * 4 + [200, 50])) == []
    lasting = play(m, windows([100] * 4 + [800] * 30))
    assert 1 <= len(lasting) <= 5


def test_watch():
    row = lambda t, m: {"arrival": int(t * 1000), "template": m, "host": "h", "severity": 4, "message": m}
    m = Watch(100_000, 10_000, 5.0, 20, 10)
    assert play(m, [row(50, "disk"), row(1000, "disk")]) == []
    assert [x[1] for x in play(m, [row(1000, "panic"), row(1001, "panic")])] == ["new"]
    steady = [row(w * 10 + i, "d") for w in range(12) for i in range(2)]
    assert play(m, steady + [row(120 + i * 0.1, "d") for i in range(15)]) == []
    burst = [row(120 + i * 0.1, "d") for i in range(40)]
    assert len(play(m, steady + burst)) == 1
    assert len(play(m, steady + burst + [row(130 + i * 0.1, "d") for i in range(40)])) == 1
    notes = [{"arrival": t, "kind": "new", "template": "t", "host": "h", "severity": 3, "n": 1, "usual": 0, "sample": ""} for t in (0, 1, 2, 59_999, 60_000)]
    assert [x[0] for x in play(PerMinute(2), notes)] == [0, 1, 60_000]


def test_rate_limit():
    rows = lambda t, n, h="a": [{"arrival": t, "id": 0, "host": h}] * n
    ok = lambda out: sum(x[3] for x in out)
    m = RateLimit(10, 20)
    assert ok(play(m, rows(0, 50))) == 20
    assert ok(play(m, rows(0, 50) + rows(500, 50))) == 25
    assert ok(play(m, rows(0, 50) + rows(500, 50) + rows(1500, 50))) == 35
    assert ok(play(m, rows(0, 50) + rows(60_000, 100))) == 40 and ok(play(RateLimit(10), rows(0, 100))) == 40
    hosts = [r for i in range(10) for r in rows(0, 10, f"h{i}")]
    assert ok(play(BothLimits(100, 0, 10), hosts)) == 40
    three = [r for h in "abc" for r in rows(0, 10, h)]
    assert ok(play(BothLimits(2, 2, 100), three)) == 6


def test_quota():
    out = play(Quota(10, 500), [{"arrival": t, "token": "t", "events": n} for t, n in ((0, 90), (0, 50), (0, 1), (10_000, 1))])
    assert [x[3] > 0 for x in out] == [False, False, True, False]
    out = play(Quota(None, 100), [{"arrival": t, "token": "t", "events": 100} for t in (0, 1, 86_400_000)])
    assert [x[3] for x in out] == [0, 86_400, 0]


def test_multiline_and_chunks():
    lines = ["start", " a", " b", "next", " c"]
    rows = [{"arrival": i, "file": "f", "line": i, "text": x} for i, x in enumerate(lines)]
    assert [x[3] for x in play(Multiline(), rows, 10_000)] == ["start\n a\n b", "next\n c"]
    assert [x[2] for x in play(Multiline(most=2), rows, 10_000)] == [2, 1, 2]
    chunk = lambda t, i, d: {"arrival": t, "peer": "p", "number": i, "of": 2, "data": d}
    assert play(Chunks(), [chunk(0, 1, "62"), chunk(1, 1, "ff"), chunk(2, 0, "61")]) == [("p", 2, "6162")]
    assert play(Chunks(), [chunk(0, 0, "61"), chunk(6000, 1, "62")]) == []


@pytest.fixture
def arrivals(spark):
    rows = [(i, t, t, f"h{i % 3}", "a", 6, f"m{i % 4}", None) for i, t in enumerate(range(0, 200_000, 997))]
    return spark.createDataFrame(rows, "id long, ts long, arrival long, host string, app string, severity int, message string, fields map<string,string>")


def test_batch_equals_stream(spark, arrivals, tmp_path):
    arrivals.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    for i, m in enumerate((Dedup(30_000), RateLimit(0.2, 3), PatternAlert("r", 3, 60_000, 90_000))):
        want = sorted(map(tuple, batch.fold(arrivals, m).collect()))
        q = live.machine(stream, m, clock=lambda: 0).writeStream.outputMode("append").format("memory").queryName(f"m{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        end = time.time() + 90  # timers keep a query busy for good: wait for the rows, not for the query to rest
        while time.time() < end and q.isActive and spark.table(f"m{i}").count() < len(want):
            time.sleep(0.5)
        q.stop()
        assert sorted(map(tuple, spark.table(f"m{i}").collect())) == want


def test_volume_forms_agree(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 40_000_000), f"h{rng.randrange(3)}") for i in range(3000)]
    logs = spark.createDataFrame(rows, "id long, arrival long, host string")
    m = Volume(300_000, 5, 2.0, 1.8, 0.5, 900_000)
    a, b = (sorted(map(tuple, f(logs, m).collect())) for f in (batch.volume, batch.volume_by_expression))
    assert a == b and a


def test_joined_lines(spark):
    rows = [("f", i, x) for i, x in enumerate(["start", " a", " b", "next", " c"])]
    df = spark.createDataFrame(rows, "file string, line long, text string")
    assert sorted(r.text for r in batch.joined_lines(df, r"^\S").collect()) == ["next\n c", "start\n a\n b"]


def test_tail_and_writer(spark, arrivals, tmp_path):
    from lumberline.plans.query import Query

    arrivals.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).parquet(str(tmp_path / "in"))
    q = live.tail(stream, Query(q="M1", host="h1")).writeStream.format("memory").queryName("tail").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "t")).start()
    assert q.awaitTermination(60)
    assert spark.table("tail").count() == arrivals.where("host = 'h1' and message = 'm1'").count() > 0
    w = live.written(live.pipeline(stream).drop("arrival"), str(tmp_path / "out"), str(tmp_path / "w"), True)
    assert w.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == arrivals.count()
    spans = arrivals.select(F.lit("t").alias("trace_id"), F.col("message").alias("span_id"))
    spans.write.parquet(str(tmp_path / "s"))
    for i in range(2):
        s = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "s"))
        assert live.spans_written(s, str(tmp_path / "so"), str(tmp_path / f"sc{i}"), True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "so")).count() == 4
