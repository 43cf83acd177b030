"""Cases that the other tests of these operators leave out."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumberline.llm import bpe, exact, packing, repeats, shared, urls

DOCS = "doc_id long, text string, lang string, source string"


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_keeps_no_long_pieces_and_refuses_other_models(tmp_path):
    v = bpe.vocabulary(vocabulary())
    whole = v.encode("a" * 5000 + " word" + "é" * 40)
    assert set(v) == {" word"} or all(len(p) <= bpe.SHORT for p in v)
    assert b"".join(v.decode(whole)).decode() == "a" * 5000 + " word" + "é" * 40
    other = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        bpe.vocabulary(other)
    spec = json.loads(v.spec) | {"normalizer": {"type": "NFC"}}
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.vocabulary(str(tmp_path / "x.json"))


def test_counts_of_many_words_at_once(monkeypatch):
    v, rng = bpe.vocabulary(vocabulary()), random.Random(4)
    parts = ["a", "the", "ing", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "'s", "'", "x1", "½", "日本", "é", "?!", "<|endoftext|>", "Anblewh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", " ", "é" * 40 + " " + "ab" * 3000, "a   b", "a  "]
    want = [len(v.encode(t or "")) // 4 for t in texts]
    for together, most in ((bpe.TOGETHER, bpe.REMEMBERED), (50, 20)):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "REMEMBERED", most)
        c = bpe.Counts(v)
        assert c.count(pa.array(texts)) == want and c.count(pa.array(texts).slice(7, 9)) == want[7:16]
    assert c.count(pa.array([], pa.string())) == [] and c.count(pa.array([None], pa.string())) == [0]
    words, calls, one = " ".join(f"w{i}q" for i in range(2000)), [], v.merged
    n = len(v.encode(words)) // 4
    v.clear()
    monkeypatch.setattr(bpe.Bpe, "merged", lambda self, piece: calls.append(piece) or one(piece))
    assert bpe.Counts(v).count(pa.array([words])) == [n] and len(calls) <= 3  # no word but the first is merged on its own


def test_copies_of_one_id_keep_the_least_row(spark):
    rows = [(1, "a b", lang, source) for lang in ("fr", "de", "en") for source in ("y", "x")] + [(None, "n  n", None, "s"), (None, "n n", "en", None), (2, "a  b", "aa", "aa")]
    for n in (1, 5):
        got = sorted((r.doc_id or -1, r.lang or "", r.source or "") for r in exact.without_copies(spark.createDataFrame(rows, DOCS).repartition(n)).collect())
        assert got == [(-1, "en", ""), (1, "de", "x")] or got == [(-1, "", "s"), (1, "de", "x")]
        assert exact.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(n)).where("group_size = 7").count() == 7


def test_null_and_repeated_ids_are_spread_over_shards(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else 7, "x" * rng.randrange(1, 400) + str(i), "en", f"s{i % 40}") for i in range(600)]
    got = packing.packed(spark.createDataFrame(rows, DOCS), 200, 50).collect()
    assert sum(r.n_tokens for r in got) == sum(-(-len(r[1]) // 4) for r in rows)
    size = Counter(r.shard for r in got)
    assert len(size) == 12 and max(size.values()) < 100


def test_pagerank_settles(spark):
    """Values against the fixed point, solved by many plain rounds; a chain of hosts that is longer than the rounds of one write."""
    pages = [(i, f"http://h{i}.com/", f'<a href="http://h{i + 1}.com/">') for i in range(30)] + [(30, "http://h30.com/", '<a href="http://bad.net/">')]
    edges = urls.links(spark.createDataFrame(pages, "page_id long, url string, html string"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    got = {r.host: r.value for r in urls.spread(spark.createDataFrame([("bad.net", 1.0)], "host string, value double"), back).collect()}
    for i in range(31):
        assert got.get(f"h{30 - i}.com", 0) == pytest.approx(0.85 ** (i + 1), abs=1e-3)
    none = spark.createDataFrame([], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 0.3), ("b", 0.0)], "host string, value double")
    assert [tuple(r) for r in urls.spread(seeds, none).collect()] == [("a", 0.3)]


def test_shared_folder(spark):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session())
    df = shared.stored(spark.range(5), "gone")
    shared.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.stored_at)


def test_texts_of_one_id_are_judged_alone(spark):
    """Rows that share a doc_id with other texts, against brute force over all rows."""
    import hashlib

    from lumberline.llm import repeats

    rng = random.Random(12)
    base = ["".join(rng.choice("abcdef ") for _ in range(200)) for _ in range(5)]
    rows = [(rng.randrange(25), rng.choice(base)[: rng.randrange(40, 200)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(60))), None, None) for _ in range(80)]
    rows += [(9, "tiny", None, None), (9, base[0], None, None), (3, base[0] + "!", None, None), (9, base[0], None, None), (None, base[0], None, None)]
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, t, *_ in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want.append((-1 if i is None else i, len(b), sum(gone), sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    got = repeats.without_repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(want)


def test_meet_over_any_batches():
    """The links of buckets don't depend on where batches are cut."""
    import numpy as np
    import pyarrow as pa

    from lumberline.llm import simhash

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = np.array(sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(40)}), dtype=np.uint64)
    rows = pa.Table.from_batches(simhash._balls(iter([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])]))).sort_by("key").combine_chunks().to_batches()[0]
    seen = []
    for size in (1, 3, 64, 1000, len(rows)):
        cut = [rows.slice(i, size) for i in range(0, len(rows), size)]
        found = {(a, b) for x in simhash._meet(iter(cut)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)}
        seen.append(found)
    assert all(x == seen[0] for x in seen) and seen[0]


def test_language_batches_agree():
    """Scores of texts together and one by one."""
    import numpy as np

    from lumberline.llm import language

    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], rng.normal(size=(3, 1 << 10)).astype(np.float32), np.log(np.array([0.2, 0.3, 0.5])))
    texts = ["one two", None, "", "12 !", "x", "lorem ipsum " * 500, "ä", "the end"]
    together, alone = model.predict(texts), [model.predict([t])[0] for t in texts]
    assert [x for x, _ in together] == [x for x, _ in alone] and np.allclose([x for _, x in together], [x for _, x in alone])
    assert [together[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and model.predict([]) == []
    assert language.Model([], np.empty((0, 1 << 10), np.float32), np.empty(0)).predict(["a", None]) == [("und", 0.0)] * 2


@pytest.mark.parametrize("passages,copies,size", [(1, 100, 30), (40, 2, 38)])
def test_contexts_that_cannot_share_a_string_are_not_contested(passages, copies, size):
    """What is in common is too short for a string of 50, whatever lies around it; 100 contexts of a gram in a task are no reason to skip that step."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [noise(60) + same + noise(60) for same in (noise(size) for _ in range(passages)) for _ in range(copies)]
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts})
    assert [x for b in repeats.found_runs(iter([rows]), 1) for x in repeats.settled_runs(iter([b]))] == []


@pytest.mark.parametrize("spread", [False, True])
def test_one_shared_string_is_found_wherever_its_anchor_lies(spark, monkeypatch, spread):
    if spread:  # every contested gram
        own = repeats.settled_runs
        monkeypatch.setattr(repeats, "settled_runs", lambda it: own(it, 1))
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows, want = [], {}
    for i in range(0, 400, 2):
        same = noise(50)
        for k in (0, 1):
            before, after = (noise(rng.randrange(3) * 30) + "#$"[k], "%&"[k] + noise(rng.randrange(3) * 30)) if i % 8 else ("", "")
            rows.append((i + k, before + same + after, None, None))
            want[i + k] = (50 * k, k)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.without_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == want


def test_contested_contexts_of_one_gram_are_spread():
    rng = random.Random(11)
    same = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))
    texts = ["".join(rng.choice("ABCDEFGH") for _ in range(60)) + same + "".join(rng.choice("ABCDEFGH") for _ in range(60)) for _ in range(600)]
    rows = [pa.record_batch({"doc_id": pa.array(range(a, a + 300)), "text": texts[a : a + 300]}) for a in (0, 300)]  # 300 of a gram in each task
    packed = [b for x in rows for b in repeats.found_runs(iter([x]), 1)]
    found = Counter(x for b in repeats.settled_runs(iter(packed)) for x in zip(b["kind"].to_pylist(), b["gram"].to_pylist(), strict=True))
    assert max(n for (kind, _), n in found.items() if kind == repeats.CONTESTED_HOT) > repeats.HOT
    assert max(n for (kind, _), n in found.items() if kind == repeats.CONTESTED) <= repeats.HOT
