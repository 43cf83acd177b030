"""Exact duplicates, near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumberline.llm import exact, repeats, simhash, suffixes

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, " "), (5, "a  b"), (6, "a\tb"), (7, "a b"), (7, "a b"), (9, "a\xa0b"), (None, "a b"), (11, "x" * 60_000), (12, "x" * 60_000 + " ")]


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, DOCS).repartition(n)


def clashing(df):
    """The same rows with other columns whose names operators use themselves, one of them twice."""
    return df.select("*", *(c.alias(n) for n, c in {"digest": F.lit(1), "keep_id": F.lit("x"), "TEXT": F.lit("other"), "bucket": F.lit(0), "fp": F.lit(0.5), "size": F.lit(None).cast("int")}.items()))


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact(spark, digest):
    rng = random.Random(1)
    rows = ODD + [(100 + i, rng.choice(["hot"] * 5 + ["p q", "p  q", "r", "s" * 9])) for i in range(300)]
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    for df in (frame(spark, rows), clashing(frame(spark, rows))):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(df, digest=digest).collect())
        want = []
        for i, t in rows:
            g = groups[normal(t)]
            keep = min(x for x in g if x is not None)
            want.append((-1 if i is None else i, keep, len(g), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
        assert got == sorted(want)
    kept = exact.without_copies(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(x for x in g if x is not None) for g in groups.values())


def test_exact_is_native(spark):
    plan = exact.exact_dedup(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """doc -> smallest doc reachable over fingerprints at 3 or fewer bits."""
    left, out = dict(fps), {}
    while left:
        todo, group = [left.popitem()], []
        while todo:
            d, f = todo.pop()
            group.append(d)
            near = [x for x in left.items() if bin(x[1] ^ f).count("1") <= 3]
            for d2, f2 in near:
                del left[d2]
                todo.append((d2, f2))
        out |= dict.fromkeys(group, min(group))
    return out


def near_texts(rng, n):
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zz" + str(rng.randrange(50))
        out.append(" ".join(words).title() if rng.random() < 0.2 else "  ".join(words))
    return out


def test_simhash(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(near_texts(rng, 250) + [None, "", " \n", "one", "one two", "one two three", "ÀB c d", "àb c d", "w " * 40_000])]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    for df in (frame(spark, rows), clashing(frame(spark, rows + rows[:20]))):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = [r.doc_id for r in simhash.without_near_copies(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


@pytest.mark.parametrize("direct", [1 << 20, 0])
def test_simhash_links(spark, monkeypatch, direct):
    """Fingerprints around a few centres, as links and through both kinds of buckets."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(150)})
    made = np.array(fps, dtype=np.uint64)
    pairs = set()
    for side in (0, 1):
        word = made >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)
        for x in np.unique(word):
            d = np.bitwise_count(word ^ x)
            near = d <= 1
            a, b = simhash.bucket_links(made[near], d[near] == 0, side, direct)
            assert (np.bitwise_count(a ^ b) <= 3).all() or direct == 1 << 20 or len(a)
            pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert label == plain_components({f: f for f in fps})


def test_components(spark):
    rng = random.Random(4)
    edges = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b} | {(i + 1, i) for i in range(1000, 1100)}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(rows, n=50):
    first, texts = {}, {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - n + 1):
            first.setdefault(texts[i][p : p + n], i)
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        out[i] = (len(b), sum(gone), sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


def passages(rng, n):
    base = ["".join(rng.choice("ab c\0é") for _ in range(rng.randrange(400))) for _ in range(10)]
    rows = {}
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            b = rng.choice(base)
            a = rng.randrange(len(b) + 1)
            parts += [b[a : a + rng.randrange(160)], "".join(rng.choice("xyzw") for _ in range(rng.randrange(30)))]
        rows[rng.randrange(-500, 10_000)] = "".join(parts) or None
    return [*rows.items(), (10_001, "q" * 700), (10_002, "q" * 49), (10_003, "z" * 49), (10_004, "q" * 50), (10_005, "z" * 50), (10_006, "z" * 51)]


@pytest.mark.parametrize("hot,piece", [(64, 1 << 20), (2, 1 << 20), (64, 256)])
def test_repeats(spark, monkeypatch, hot, piece):
    rows = passages(random.Random(hot + piece), 160)
    own, runs = repeats.found_runs, repeats.runs_of
    monkeypatch.setattr(repeats, "found_runs", lambda it, buckets: own(it, buckets, hot))
    df = frame(spark, rows + rows[:9])
    if piece < 1 << 20:  # pieces of long texts, cut where they are cut for their length
        monkeypatch.setattr(repeats, "PIECE", piece)
        got_rows = [x for b in own(iter([to_batch(rows)]), 4) for x in b["runs"].to_pylist()]
        assert sum(len(x) for x in got_rows)
        monkeypatch.setattr(repeats, "runs_of", runs)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(clashing(df) if hot == 2 else df).collect()}
    assert got == plain_repeats(rows)


def to_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})


def test_long_texts_in_pieces(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * repeats.PIECE // 2))
    rows = [(1, long), (2, "!" + long[repeats.PIECE - 500 : repeats.PIECE + 500]), (3, long[7:]), (None, long[:200])]
    got = {r.doc_id: r for r in repeats.without_repeats(frame(spark, rows)).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3, None)] == [(0, 0), (1000, 1), (len(long) - 7, 1), (0, 0)]


def test_suffixes():
    rng = random.Random(7)
    for text in (b"", b"a", b"banana" * 20, bytes(rng.choice(b"ab") for _ in range(700)), b"\0" * 90, bytes(rng.randrange(256) for _ in range(500))):
        body, depth = np.frombuffer(text, np.uint8), 50
        order = suffixes.suffix_array(body, depth)
        padded = [(text + b"\0" * depth)[i : i + depth] for i in range(len(text))]
        assert sorted(order.tolist()) == list(range(len(text))) and [padded[i] for i in order] == sorted(padded)
        lcp = suffixes.common_prefixes(body, order, depth)
        for k in range(1, len(text)):
            a, b = padded[order[k - 1]], padded[order[k]]
            assert lcp[k] == next((i for i in range(depth) if a[i] != b[i]), depth)
    runs = []
    for _ in range(5):
        d = {bytes(rng.choice(b"abc") for _ in range(3)): rng.randrange(100) for _ in range(20)}
        runs.append((np.array(sorted(d), dtype="S3"), np.array([d[k] for k in sorted(d)])))
    want = {}
    for keys, values in runs:
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            want[k] = min(v, want.get(k, 1000))
    keys, values = suffixes.merged(runs)
    assert list(zip(keys.tolist(), values.tolist(), strict=True)) == sorted(want.items())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert [f(empty).count() for f in (exact.exact_dedup, exact.without_copies, simhash.near_duplicates, simhash.without_near_copies, repeats.without_repeats)] == [0] * 5
