"""Streams that are restarted or replayed, the order of ingestion, and caps."""

from pyspark.sql import functions as F

from lumberline.functions.parsers import Parser
from lumberline.functions.rules import Drop
from lumberline.sources import files
from lumberline.streaming import live
from lumberline.streaming.machines import BothLimits

ENTRIES = "id long, ts long, host string, app string, severity int, message string, fields map<string,string>"


def test_a_replayed_batch_is_there_once(spark, tmp_path):
    out = str(tmp_path / "out")
    a, b = (spark.createDataFrame([(i, i * 1000, "h", "a", 6, "m", None) for i in r], ENTRIES).withColumn("day", F.to_date(F.timestamp_millis("ts"))) for r in (range(5), range(5, 9)))
    for batch, number in ((a, 0), (b, 1), (b, 1), (a, 0)):
        live._put_once(batch, number, out, "/checkpoint", "day")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(9))
    live._put_once(a, 0, out, "/another", "day")
    assert spark.read.parquet(out).count() == 14


def test_the_first_span_stays(spark, tmp_path):
    ddl = "trace_id string, span_id string, name string, arrival long"
    rows = [("t", "1", "late", 9), ("t", "1", "early", 1), ("t", "2", "b", 5)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    for i in range(2):  # two queries, then the same checkpoint again after more input
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        assert live.spans_written(stream, str(tmp_path / "out"), str(tmp_path / f"c{i}"), True).awaitTermination(60)
    spark.createDataFrame([("t", "2", "again", 0), ("t", "3", "c", 7)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    assert live.spans_written(stream, str(tmp_path / "out"), str(tmp_path / "c0"), True).awaitTermination(60)
    assert sorted((r.span_id, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "early"), ("2", "b"), ("3", "c")]


def test_a_restarted_tail_goes_on(spark, tmp_path):
    source, out = tmp_path / "logs", str(tmp_path / "out")
    source.mkdir()

    def run():
        q = files.tailed(spark, str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.read.parquet(out).orderBy("id").collect()

    (source / "a.log").write_text("same\nsame\n\nlast\n")
    got = run()
    assert [(r.line, r.text) for r in got] == [(0, "same"), (1, "same"), (2, ""), (3, "last")] and len({r.id for r in got}) == 4
    (source / "b.log").write_text("same\r\nend")
    got = run()
    assert sorted((r.file[-5:], r.line, r.text) for r in got) == [("a.log", 0, "same"), ("a.log", 1, "same"), ("a.log", 2, ""), ("a.log", 3, "last"), ("b.log", 0, "same"), ("b.log", 1, "end")]


def test_order_of_ingestion(spark):
    rows = [(1, "h" * 300, "a", "CEF:0|Vendor|Product|1|7|Name|5|msg=hello src=10.0.0.1", None), (2, "web", "a", "user=7 took=5ms secret", None), (3, "web", "a", "k=v x=y plain", None), (4, "web", "a", "drop k=v x=y", None), (5, "web", "a", "é" * 20_000, None)]
    df = spark.createDataFrame([(i, i, h, a, 6, m, f) for i, h, a, m, f in rows], ENTRIES)
    parser = Parser(r"^user=(?P<uid>\d+) took=(?P<ms>\d+)ms")
    got = {r.id: r for r in live.ready(live.pipeline(df, [Drop("^drop")], parsers=[parser])).collect()}
    assert set(got) == {1, 2, 3, 5} and len(got[1].host) == 255
    assert got[1].app == "Product" and got[1].message == "Name: hello" and got[1].fields["src"] == "10.0.0.1"
    assert got[2].fields == {"uid": "7", "ms": "5"} and got[3].fields == {"k": "v", "x": "y"}
    assert len(got[5].message.encode()) == 16_384


def test_streamed_metrics_fold_into_other(spark):
    df = spark.createDataFrame([(h, t) for t, h in enumerate("abcabcddd")], "host string, arrival long")
    got = {r.host: r["count"] for r in live.capped(live.counted(df, ["host"]), ["host"], 2).collect()}
    assert got == {"a": 2, "b": 2, "_other": 5}


def test_hosts_beyond_the_most_share_a_bucket():
    m, state, out = BothLimits(1, 2, 100, most_hosts=2), None, []
    for i, host in enumerate("aabbccdde"):
        state, told = m.step(state, {"id": i, "host": host, "arrival": 0})
        out += told
    assert [x[3] for x in out] == [True] * 6 + [False] * 3 and [x[1] for x in out] == list("aabbccdde")
