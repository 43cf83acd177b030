"""SimHash near duplicates by meet-in-the-middle ball hashing.

Fingerprints: words of the text (A-Z lower-cased) in shingles of three, XXH64 with seed 42 of each shingle, and a bit is 1 where
over half the hashes have it. Two fingerprints link at ``RADIUS`` or fewer differing bits.

A fingerprint is two words of 32 bits. Of two fingerprints at most 3 bits apart one word is at most 1 apart, so every distinct
fingerprint emits, for either word, the word and all its variants within half the radius (66 rows of 17 bytes, against 2,081
for a ball of two flips over 64 bits); rows meet by a shuffle on (which word, variant) and colliding fingerprints are
verified on all 64 bits. A bucket gives a spanning set of its links, never its pairs: small buckets compare members in numpy,
large ones hash balls over the other word (radius 1 against radius 2), which takes a time in proportion to the bucket; both are
exact. A bucket is held as 17 bytes for each distinct fingerprint that shares its word: n fingerprints spread evenly give buckets of
33 n / 2**32 members a side, some 800 at 10**11.
Only distinct fingerprints travel, so that copies cost nothing here. Components come from alternating large-star and
small-star rounds in Spark; each pair of rounds is one plan, whose shuffle of the large star is read by both sides of the small
one, and one table in the shared folder. Neither links nor labels reach the driver.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; one or two words are one shingle;
repeated rows share fingerprint and component; a null doc_id joins its component but never names it, unless all are null;
an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, pick, stored

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Comparisons up to which a bucket is compared directly.
DIRECT = 1 << 20
HASHES = 1 << 15
ONES = np.uint32(1) << np.arange(32, dtype=np.uint32)
TWOS = np.array([ONES[i] | ONES[j] for i in range(32) for j in range(i)], dtype=np.uint32)


def hashes(text: str | None) -> list[int]:
    """XXH64 of each shingle; repeats count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: 1 - SHINGLE - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)]


def fingerprint(text: str | None) -> int:
    found = hashes(text)
    if not found:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), HASHES):
        part = np.array(found[i : i + HASHES], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py()) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For either word of each fingerprint: the word itself (exact) and its 32 variants of one flip."""
    flips = np.concatenate(([np.uint32(0)], ONES))
    for b in batches:
        whole = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(whole), 4096):
            fp = whole[i : i + 4096]
            for side in (0, 1):
                word = (fp >> np.uint64(32 * side)).astype(np.uint32)
                key = ((word[:, None] ^ flips[None, :]).astype(np.int64) | np.int64(side << 32)).ravel()
                exact = np.tile(np.arange(33) == 0, len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp, 33).view(np.int64)), pa.array(exact)], ["key", "fp", "exact"])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _direct(fp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the first n fingerprints and all."""
    i, j = (np.bitwise_count(fp[:n, None] ^ fp[None, :]) <= RADIUS).nonzero()
    return i, j


def _by_balls(word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, spanning, for many members. word: the other word of each; the first n agree in the bucket's word, the rest are one flip off.

    Members that share a variant of one flip are within 2 on this word, and one of the first n with any other member is within 3
    in all: each of them links to one of the first n that has the variant. Two of the first n that are 3 apart on this word have
    different parity: the even ones spread one flip, the odd ones look up two.
    """
    flips = np.concatenate(([np.uint32(0)], ONES))
    near = (word[:n, None] ^ flips[None, :]).ravel()
    owner = np.repeat(np.arange(n), len(flips))
    order = np.argsort(near, kind="stable")
    near, owner = near[order], owner[order]
    a, b = [], []

    def look(who: np.ndarray, masks: np.ndarray, near: np.ndarray, owner: np.ndarray) -> None:
        for i in range(0, len(who), 4096):
            part = who[i : i + 4096]
            want = (word[part][:, None] ^ masks[None, :]).ravel()
            at = np.searchsorted(near, want).clip(max=len(near) - 1)
            hit = near[at] == want
            pairs = np.unique(np.stack([np.repeat(part, len(masks))[hit], owner[at[hit]]]), axis=1)
            a.append(pairs[0])
            b.append(pairs[1])

    look(np.arange(len(word)), flips, near, owner)
    even = np.bitwise_count(word[owner]) % 2 == 0
    if even.any():
        odd = np.arange(n)[np.bitwise_count(word[:n]) % 2 == 1]
        look(odd, TWOS, near[even], owner[even])
    return np.concatenate(a), np.concatenate(b)


def bucket_links(fp: np.ndarray, exact: np.ndarray, side: int, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links of one bucket: each fingerprint to the first of its component."""
    fp = np.concatenate([fp[exact], fp[~exact]])
    n = int(exact.sum())
    if n * len(fp) <= direct:
        a, b = _direct(fp, n)
    else:
        a, b = _by_balls((fp >> np.uint64(32 * (1 - side))).astype(np.uint32), n)
    label = _labels(len(fp), a, b)
    far = (label != np.arange(len(fp))).nonzero()[0]
    return fp[far], fp[label[far]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket; rows come sorted by key, and a bucket may span batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(key: np.ndarray, fp: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate(([True], key[1:] != key[:-1])).nonzero()[0]
        size = np.diff(np.append(first, len(key)))
        some = np.add.reduceat(exact.astype(np.int64), first) > 0
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        two = first[some & (size == 2)]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS
        a.append(fp[two][near])
        b.append(fp[two + 1][near])
        for s, n in zip(first[some & (size > 2)].tolist(), size[some & (size > 2)].tolist(), strict=True):
            x, y = bucket_links(fp[s : s + n], exact[s : s + n], int(key[s] >> 32))
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def whole() -> pa.RecordBatch:
        return links(*(np.concatenate(c) for c in zip(*held, strict=True)))

    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy(zero_copy_only=False)
        fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        exact = batch["exact"].to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1])) if not held or key[-1] != held[-1][0][-1] else 0
        if held and (cut or key[0] != held[-1][0][-1]):  # the last bucket held ends before the last one of this batch
            held.append((key[:cut], fp[:cut], exact[:cut]))
            yield whole()
            held = []
        elif cut:
            yield links(key[:cut], fp[:cut], exact[:cut])
        held.append((key[cut:], fp[cut:], exact[cut:]))
    if held:
        yield whole()


def near_links(fps: DataFrame) -> DataFrame:
    """Distinct links (a > b) between distinct fingerprints; they span every component.

    Distinct fingerprints are few bytes, and adaptive execution would leave them in few tasks; balls are many: they are dealt anew.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = fps.select("fp").distinct().repartition(tasks, "fp").mapInArrow(_balls, "key long, fp long, exact boolean")
    met = balls.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_meet, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of the links (a > b).

    Only the links after a small star are written: tables of few rows over many partitions cost files more than work.
    """
    edges = stored(links.select("a", "b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        old = edges
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(least, "a")
        small = turned.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "small-star")
        discard(old)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = stored(fingerprints(docs), "fingerprints")
    roots = components(near_links(rows))
    of = rows.groupBy("fp").agg(F.min("doc_id").alias("lead")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leads = of.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = of.select("fp", "root").join(leads, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns: of each component the row with the smallest doc_id."""
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    none = F.lit(-(2**63))
    keep = stored(found.select(F.coalesce("doc_id", none).alias("id")).distinct(), "near")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    rows = plain.withColumn("id", F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), none))
    kept = rows.join(keep.hint("merge"), "id", "left_semi")  # the same plan at every size: ids grow with the corpus
    return kept.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)
