"""Repeated passages: bytes covered by a ``LENGTH``-byte string that also starts in a document with a smaller doc_id.

Suffix arrays of whole shards would have to exchange every position of the corpus with fifty bytes to it. Equal strings
therefore first meet by anchors: of the 35 grams of 16 bytes in a string the one with the least hash (the leftmost of equals) is its
anchor, so that equal strings have equal anchors at equal offsets, and nothing is lost. About one position in 17 is an anchor;
consecutive strings with the same anchor position form a run, and its context is all the bytes that they cover.

1. Each task finds the runs of its documents and keeps, of equal (gram, context), those of the smallest document; the others are
   decided, for a smaller document has all their strings. Packed runs are exchanged by gram, where the same rule decides again.
   What remains of a gram has one context each; where a gram has several, from several documents, they may still share strings: a
   string that holds the gram has 23 or more of its other 34 bytes before it, or after it, or 12 on both sides, so that contexts are
   contested if another document's has the same 23 bytes before the gram, or 23 after it, or 12 around it (by 16-bit hashes, which
   only add contexts). A gram with over ``HOT`` contexts in one task skips this step with all but one of them, is contested
   and hot, and is spread by document, so that no gram gathers in one task: ``HOT`` times the tasks
   is the most here, and over ``HOT`` that are contested in the end are spread too.
2. Contested contexts are cut from the texts and dealt to shards by gram. Each shard builds a suffix array (Larsson-Sadakane),
   Kasai's common prefixes tell which strings are equal, and the strings of all but the smallest document are decided. Hot grams
   lie in many shards: each shard's sorted distinct strings are exchanged and merged by binary search.
3. Decided strings meet their documents, and the uncovered bytes remain.

Tasks are as many as the input's bytes ask for (``TASK_BYTES`` in each, from the plan's statistics), so that none grows with the input.
A document's spots are collected to its row: they are at most as many as its text has bytes.

Places carry their text in their upper bits, a hash of ``VARIANT_BITS``, so that texts of one doc_id stay apart.

Steps 1 and 2 end in the shared folder. Contexts compare by a 64-bit hash next to the 64-bit hash of their gram, contested ones byte
by byte.

Defined cases: a null text counts as empty; texts under 50 bytes keep all; a string repeated inside one document only is kept;
rows of one doc_id are one document with several texts: none is smaller than another, each is judged alone, and equal ones alike; a
null doc_id is never smaller and nothing is smaller than it, so its row keeps all; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, stored
from .suffixes import common_prefixes, merged, suffix_array

LENGTH = 50
GRAM = 16
HOT = 512
NEAR = 12
PIECE = 1 << 20
RUNS = 1 << 20
BUCKETS = 8
UNDECIDED, UNDECIDED_HOT, DECIDED, CONTESTED, CONTESTED_HOT = range(5)
RUN = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "u1"), ("kind", "u1"), ("left", "<u2"), ("right", "<u2"), ("around", "<u2")])
SIDES = ("left", "right", "around")
SHARDS = 4
TASK_BYTES = 8 << 20
TASKS_MOST = 1 << 16
PLACE_BITS, VARIANT_BITS = 40, 23
PLACE = (1 << PLACE_BITS) - 1
TOGETHER = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_of(body: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """gram, context, start, n, left, right and around of the runs of texts that end at ``ends`` in body, PIECE bytes at most."""
    window = length - gram + 1
    words = np.ndarray((len(body) + 1,), "<u8", body + b"\0" * 8, strides=(1,)).copy()
    if len(body) < length:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, np.uint16)] * 3)
    grams = words[: len(body) - gram + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, gram - 7, 8):
        grams = mix(grams) ^ words[k : k + len(grams)]
    grams = mix(grams)
    low = np.uint64(PIECE * 2 - 1)
    least, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= window:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < window:
        least = np.minimum(least[: len(least) - window + span], least[window - span :])
    inside = np.ones(len(least), bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1) : end] = False
    places = inside.nonzero()[0]
    anchor = (least[places] & low).astype(np.int64)
    first = np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(anchor)].nonzero()[0]
    start, n, anchor = places[first], np.diff(np.append(first, len(anchor))), anchor[first]
    stop = start + n + length - 1
    context = n.astype(np.uint64) << np.uint64(8) | (anchor - start).astype(np.uint64)
    for k in range(-(-(window + length) // 8)):
        context = mix(context ^ words[np.minimum(start + 8 * k, stop - 8)])
    far, last = length - gram - NEAR + 1, len(body)
    left, right = _side(words, np.maximum(anchor - far, 0), far), _side(words, np.minimum(anchor + gram, last - far), far)
    around = mix(_side(words, np.maximum(anchor - NEAR, 0), NEAR)) ^ _side(words, np.minimum(anchor + gram, last - NEAR), NEAR)
    return grams[anchor], context, start, n, *(x.astype(np.uint16) for x in (left, right, around))


def _side(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` bytes from each place, where that many lie in the text; of whatever else where they don't."""
    found = np.zeros(len(at), np.uint64)
    for k in (*range(0, size - 7, 8), size - 8):
        found = mix(found ^ words[at + k])
    return found


def decide(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order, which are decided (a smaller document has the context), and the number of the gram of each."""
    grams = runs["gram"].copy()
    order = np.argsort(grams)
    grams = grams[order]
    gram = np.concatenate(([True], grams[1:] != grams[:-1]))[: len(runs)]
    tied = (~(gram & np.append(gram[1:], True)[: len(runs)])).nonzero()[0]  # most grams have one run, and no order to find
    few = runs[order[tied]]
    order[tied] = order[tied][np.lexsort((few["start"], few["doc"], few["context"], few["gram"]))]
    runs = runs[order]
    context = gram | np.concatenate(([True], runs["context"][1:] != runs["context"][:-1]))[: len(runs)]
    first = runs["doc"][context][np.cumsum(context) - 1]
    return runs, runs["doc"] > first, np.cumsum(gram) - 1


def pack(runs: np.ndarray) -> bytes:
    """Column by column and byte plane by byte plane, which the shuffle's compression likes."""
    return b"".join(np.ascontiguousarray(runs[f]).view(np.uint8).reshape(len(runs), -1).T.tobytes() for f in RUN.names)


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // RUN.itemsize
    runs, at = np.empty(n, RUN), 0
    for f in RUN.names:
        size = RUN[f].itemsize
        runs[f] = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(RUN[f]).ravel()
        at += n * size
    return runs


def found_runs(batches: Iterator[pa.RecordBatch], buckets: int, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Packed runs of whole texts, by bucket."""
    parts, held, docs, texts, size = [], 0, [], [], 0

    def take() -> None:
        nonlocal held, docs, texts, size
        if texts:
            ends = np.cumsum([len(t) for t in texts])
            gram, context, start, n, *sides = runs_of(b"".join(texts), ends)
            which = np.searchsorted(ends, start, side="right")
            runs = np.empty(len(gram), RUN)
            runs["gram"], runs["context"], runs["n"], runs["kind"] = gram, context, n, UNDECIDED
            runs["left"], runs["right"], runs["around"] = sides
            runs["doc"] = np.array([d for d, _ in docs])[which]
            runs["start"] = start - np.concatenate(([0], ends))[which] + np.array([s for _, s in docs])[which]
            parts.append(runs)
            held += len(runs)
        docs, texts, size = [], [], 0

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal parts, held
        if not held:
            return
        runs, done, which = decide(np.concatenate(parts))
        parts, held = [], 0
        runs["kind"][done] = DECIDED
        many = np.bincount(which[~done], minlength=which[-1] + 1)[which] > hot
        if many.any():
            smallest = np.full(which[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, which, runs["doc"])
            one = many & ~done & (runs["doc"] == smallest[which])
            runs["kind"][many & ~done] = CONTESTED_HOT
            runs["kind"][one] = UNDECIDED_HOT
        moving = runs["kind"] <= UNDECIDED_HOT
        bucket = (np.where(moving, runs["gram"], mix(runs["doc"].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        runs, bucket = runs[order], bucket[order]
        cuts = np.concatenate(([True], bucket[1:] != bucket[:-1])).nonzero()[0]
        blobs = [pack(runs[a:b]) for a, b in zip(cuts, [*cuts[1:], len(runs)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "runs"])

    for b in batches:
        bases = b["base"].to_pylist() if "base" in b.schema.names else [0] * len(b)
        for doc, text, base in zip(b["doc_id"].to_pylist(), b["text"], bases, strict=True):
            whole = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for start in range(0, max(0, len(whole) - LENGTH + 1), PIECE - LENGTH + 1):
                piece = whole[start : start + PIECE]
                if size + len(piece) > PIECE:
                    take()
                docs.append((doc, base + start))
                texts.append(piece)
                size += len(piece)
                if held > RUNS:
                    yield from give()
    take()
    yield from give()


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each key; they come sorted by it."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        keys = b[key].to_numpy(zero_copy_only=False)
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = b.slice(i, j - i)
            if waiting and waiting[0][key][0].as_py() != part[key][0].as_py():
                yield waiting[0][key][0].as_py(), pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(part)
    if waiting:
        yield waiting[0][key][0].as_py(), pa.Table.from_batches(waiting)


def _rows(runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(runs["doc"]), pa.array(runs["start"]), pa.array(runs["n"].astype(np.int64)), pa.array(runs["kind"].astype(np.int32)), pa.array(runs["gram"].view(np.int64))], ["doc", "start", "n", "kind", "gram"])


def _shared(which: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same side of the same gram."""
    _, group = np.unique(which << 16 | side, return_inverse=True)
    low, high = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    return (low != high)[group]


def settled_runs(batches: Iterator[pa.RecordBatch], hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the decided and the contested runs; what is neither stays out. A gram with over ``hot`` contested ones is hot as well."""
    for _, blobs in _by_key(batches, "bucket"):
        runs = np.concatenate([unpack(x.as_py()) for x in blobs["runs"]])
        free = runs["kind"] <= UNDECIDED_HOT
        rest = runs[~free]
        if len(rest):
            yield _rows(rest)
        if not free.any():
            continue
        runs, done, which = decide(runs[free])
        n = which[-1] + 1
        warm = np.bincount(which[runs["kind"] == UNDECIDED_HOT], minlength=n) > 0
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, which[~done], runs["doc"][~done])
        np.maximum.at(high, which[~done], runs["doc"][~done])
        several = (~done & (low != high)[which] & ~warm[which]).nonzero()[0]
        contested = ~done & warm[which]
        for side in SIDES:
            contested[several] |= _shared(which[several], runs[side][several], runs["doc"][several])
        runs["kind"][done] = DECIDED
        warm |= np.bincount(which[contested], minlength=n) > hot
        runs["kind"][contested] = np.where(warm[which[contested]], CONTESTED_HOT, CONTESTED)
        if (done | contested).any():
            yield _rows(runs[done | contested])


def cut_contexts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The bytes of contested runs (spots: start, n, gram, hot) of each text."""
    for b in batches:
        for doc, text, spots in zip(b["doc_id"].to_pylist(), b["text"], b["spots"], strict=True):
            whole = (text.as_py() or "").encode("utf-8", "surrogatepass")
            fields = spots.values
            start, n, hot = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "hot"))
            gram = fields.field("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            salt = mix(np.full(len(gram), doc, np.int64).view(np.uint64))
            shard = (np.where(hot, mix(gram ^ salt), gram) % np.uint64(shards)).astype(np.int64)
            bodies = [whole[s : s + k + LENGTH - 1] for s, k in zip((start & PLACE).tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([doc] * len(start), pa.int64()), pa.array(start), pa.array(hot), pa.array(bodies, pa.binary())], ["shard", "doc", "start", "hot", "body"])


def _spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of strings as runs: doc, first start, number."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))[: len(doc)].nonzero()[0]
    last = np.append(head[1:], len(doc)) - 1
    return (doc[head], start[head], start[last] - start[head] + 1) if len(doc) else (doc, start, start)


def shard_strings(doc: np.ndarray, start: np.ndarray, hot: np.ndarray, bodies: list[bytes]) -> tuple[tuple, tuple]:
    """Of one shard's contexts: the decided starts (doc, start); and, of hot contexts, the smallest document's strings in order (string, doc, start)."""
    size = np.array([len(x) for x in bodies])
    body = np.frombuffer(b"".join(bodies), np.uint8)
    order = suffix_array(body, LENGTH)
    shared = common_prefixes(body, order, LENGTH)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(body)) - first[owner]
    string = offset <= size[owner] - LENGTH
    group = np.cumsum(shared < LENGTH) - 1 if len(order) else order
    keep = string[order]
    at, group = order[keep], group[keep]
    who = owner[at]
    head = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)].nonzero()[0]
    least = np.minimum.reduceat(doc[who], head) if len(head) else np.empty(0, np.int64)
    which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(group))))
    lost = doc[who] > least[which]
    left = ~lost & hot[who]
    strings = np.lib.stride_tricks.sliding_window_view(body, LENGTH)[at[left]] if left.any() else np.empty((0, LENGTH), np.uint8)
    return (doc[who[lost]], start[who[lost]] + offset[at[lost]]), (strings, doc[who[left]], start[who[left]] + offset[at[left]])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, small ones with their neighbours: equal strings lie in one shard, and more of them change nothing."""
    waiting, size = [], 0
    for _, rows in _by_key(batches, "shard"):
        waiting.append(rows)
        size += rows["body"].nbytes
        if size >= TOGETHER:
            yield pa.concat_tables(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_tables(waiting)


def sharded(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Decided starts (bucket null) and sorted runs of hot strings (packed, by bucket) of each shard."""
    for rows in _together(batches):
        done, (strings, doc, start) = shard_strings(*(rows[c].to_numpy() for c in ("doc", "start", "hot")), rows["body"].to_pylist())
        d, s, n = _spans(*done)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(s), pa.array(n), pa.nulls(len(d), pa.binary())], ["bucket", "doc", "start", "n", "strings"])
        if len(doc):
            words = np.ascontiguousarray(strings[:, :48]).view("<u8").reshape(len(strings), -1)
            key = mix(words[:, 0])
            for k in range(1, words.shape[1]):
                key = mix(key ^ words[:, k])
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            for x in np.unique(bucket).tolist():
                here = bucket == x
                blob = strings[here].tobytes() + doc[here].astype("<i8").tobytes() + start[here].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], ["bucket", "doc", "start", "n", "strings"])


def merged_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decided starts among the hot strings of all shards."""
    for _, rows in _by_key(batches, "bucket"):
        runs = []
        for x in rows["strings"]:
            blob = x.as_py()
            n = len(blob) // (LENGTH + 16)
            runs.append((np.frombuffer(blob, f"S{LENGTH}", n), np.frombuffer(blob, "<i8", n, n * LENGTH), np.frombuffer(blob, "<i8", n, n * (LENGTH + 8))))
        distinct = []
        for strings, doc, _ in runs:
            head = np.concatenate(([True], strings[1:] != strings[:-1])).nonzero()[0]
            distinct.append((strings[head], np.minimum.reduceat(doc, head)))
        known, least = merged(distinct)
        for strings, doc, start in runs:
            lost = doc > least[np.searchsorted(known, strings)]
            d, s, n = _spans(doc[lost], start[lost])
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(n)], ["doc", "start", "n"])


def covered(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered stretches of strings that start at (start, n) each."""
    out: list[list[int]] = []
    for start, n in sorted(spots):
        end = start + n + LENGTH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spots in zip(b["text"], b["spots"], strict=True):
            whole = (text.as_py() or "").encode("utf-8", "surrogatepass")
            gone = covered([(x["start"], x["n"]) for x in spots.as_py() or ()])
            kept, at = hashlib.sha256(), 0
            for a, z in gone:
                kept.update(whole[at:a])
                at = z
            kept.update(whole[at:])
            out.append((len(whole), sum(z - a for a, z in gone), len(gone), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc, start and n: from start on, n consecutive strings of LENGTH bytes also start in a smaller document."""
    tasks = tasks_for(docs)
    buckets, shards = BUCKETS * tasks, SHARDS * tasks
    texts = _texts(docs).where("doc_id is not null")
    packed = texts.mapInArrow(lambda it: found_runs(it, buckets), "bucket long, runs binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    runs = stored(packed.mapInArrow(settled_runs, "doc long, start long, n long, kind int, gram long"), "runs")
    spots = runs.where(F.col("kind") > DECIDED).groupBy(F.col("doc").alias("doc_id"), _base().alias("base")).agg(F.collect_list(F.struct("start", "n", "gram", (F.col("kind") == CONTESTED_HOT).alias("hot"))).alias("spots"))
    cut = texts.join(spots, ["doc_id", "base"]).mapInArrow(lambda it: cut_contexts(it, shards), "shard long, doc long, start long, hot boolean, body binary")
    told = cut.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(lambda it: sharded(it, buckets), "bucket long, doc long, start long, n long, strings binary")
    told = stored(told, "shards")
    across = told.where("bucket is not null").select("bucket", "strings").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(merged_shards, "doc long, start long, n long")
    return runs.where(F.col("kind") == DECIDED).select("doc", "start", "n").unionByName(told.where("bucket is null").select("doc", "start", "n")).unionByName(across)


def _texts(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    variant = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << VARIANT_BITS) - 1))
    return rows.withColumn("base", F.shiftleft(variant, PLACE_BITS))


def _base() -> Column:
    return F.col("start").bitwiseAND(F.lit(~PLACE))


def tasks_for(docs: DataFrame) -> int:
    """Tasks for the bytes that the plan's statistics give; the session's number where they know none (they say 2**63 - 1 then)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own if size >= 1 << 60 else max(own, min(TASKS_MOST, size // TASK_BYTES))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    place = F.col("start").bitwiseAND(F.lit(PLACE)).alias("start")
    spots = repeated_starts(docs).groupBy(F.col("doc").alias("doc_id"), _base().alias("base")).agg(F.collect_list(F.struct(place, "n")).alias("spots"))
    return _texts(docs).join(spots, ["doc_id", "base"], "left").drop("base").mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
