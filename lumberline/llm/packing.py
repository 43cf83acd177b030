"""Best-fit packing of documents into sequences of ``capacity`` tokens, with conflicts.

Bins are held in order of their residual. A piece, largest first, goes to the tightest bin that it fits and that has neither its
source nor its duplicate cluster: the successor search starts at the smallest residual that is large enough and goes on, bin by
bin, until one is compatible; the bins' bitmaps of sources and clusters decide. A new bin opens only if no bin is.

A document over the capacity fills bins of its own with whole pieces, and its rest is packed. Rows are dealt to shards by a hash
of doc_id, source and cluster (so that null or repeated ids gather nowhere), about ``shard_rows`` in each, and every shard is packed in one task from (doc_id, tokens, source, cluster) alone: its
memory is bounded whatever the sources and clusters, and a source with a third of all rows is spread over all shards.

Sizes are tokens of a vocabulary where ``vocabulary`` is given (its path). Without it, and without ``tokens``, they are an
estimate, a token for ``BYTES_A_TOKEN`` bytes: real vocabularies make more of most texts, and such bins overflow their sequence.

Defined cases: a null or empty text has no tokens and takes one piece of size 0; a null source conflicts with nothing; the
cluster is the hash of the normalised text unless a column is given; repeated rows are packed one by one and conflict as copies;
ties go to the smaller doc_id, then the smaller source, then the older bin; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .exact import normalised
from .shared import pick

CAPACITY = 2048
SHARD_ROWS = 2048
BYTES_A_TOKEN = 4


class Bins:
    """Open bins in order of (residual, number), each with a bitmap of sources and one of clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.sources, self.clusters = capacity, [], [], []

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are bitmaps of one bit, or of none."""
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            residual, n = self.order[i]
            if not (self.sources[n] & source or self.clusters[n] & cluster):
                del self.order[i]
                break
            i += 1
        else:
            residual, n = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[n] |= source
        self.clusters[n] |= cluster
        if residual > size or not size:
            insort(self.order, (residual - size, n))
        return n, self.capacity - residual


def pack_shard(rows: pd.DataFrame, capacity: int) -> list[tuple]:
    """(row, piece, bin, offset, tokens) of every piece of the rows (doc_id, n_tokens, source, cluster)."""
    out, bins, whole, todo = [], Bins(capacity), 0, []
    bits = {s: 1 << i for i, s in enumerate(sorted({s for s in rows["source"] if s is not None}))}
    groups = rows["cluster"].value_counts()
    shared = {c: 1 << i for i, c in enumerate(sorted(groups[groups > 1].index))}  # a cluster of one conflicts with nothing
    for row, (size, source, cluster) in enumerate(zip(rows["n_tokens"], rows["source"], rows["cluster"], strict=True)):
        full, rest = divmod(int(size), capacity)
        for piece in range(full):
            out.append((row, piece, -1 - whole, 0, capacity))
            whole += 1
        if rest or not full:
            todo.append((-rest, row, full, bits.get(source, 0), shared.get(cluster, 0)))
    for size, row, piece, source, cluster in sorted(todo):
        n, offset = bins.add(-size, source, cluster)
        out.append((row, piece, n, offset, -size))
    return out


def digest(text: str) -> int:
    """64 bits of the text with runs of white space as one space."""
    raw = text.encode("utf-8", "surrogatepass")
    body = b" ".join(raw.split())
    return xxhash.xxh64_intdigest(b" " * raw[:1].isspace() + body + b" " * (raw[-1:].isspace() and len(body) > 0)) - (1 << 63)


def counted(rows: DataFrame, path: str) -> DataFrame:
    """The rows with their tokens in place of the text: every whole text is counted, and none goes on to the shuffle. A column ``cluster``
    of nulls is filled with a hash of the normalised text."""
    shared = rows.sparkSession.sparkContext.broadcast(bpe.Counts(bpe.vocabulary(path)))
    rest = [c for c in rows.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = shared.value.count(b["text"])
            found = {c: b[c] for c in rest}
            if found["cluster"].null_count == len(b):
                found["cluster"] = pa.array([digest(t.as_py() or "") for t in b["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([*found.values(), pa.array(n, pa.int64())], [*rest, "n_tokens"])

    return rows.mapInArrow(each, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest) + ", n_tokens long")


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, tokens: Column | None = None, cluster: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, shard, bin, start (its offset in the bin) and n_tokens of every piece; bins are numbered within their shard."""
    rows = pick(docs, "doc_id", "text", "source")
    size = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / BYTES_A_TOKEN) if tokens is None else tokens
    group = F.xxhash64(normalised(F.col("text"))) if cluster is None else cluster
    shards = max(1, -(-docs.count() // shard_rows))
    if vocabulary is not None and cluster is None:
        group = F.lit(None)  # from the text that the encoder reads anyway
    small = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), group.cast("long").alias("cluster")]
    small = rows.select(*small, size.cast("long").alias("n_tokens")) if vocabulary is None else counted(rows.select(*small, "text"), vocabulary)
    small = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster"), F.lit(shards)).cast("long"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype({"source": object, "doc_id": "Int64"}).sort_values(["doc_id", "source", "cluster", "n_tokens"], na_position="last", kind="stable").reset_index(drop=True)
        rows["source"] = rows["source"].where(rows["source"].notna(), None)
        found = pd.DataFrame(pack_shard(rows, capacity), columns=["row", "piece", "bin", "start", "n_tokens"])
        found["doc_id"] = rows["doc_id"].to_numpy()[found["row"]]
        found["shard"] = int(rows["shard"].iloc[0])
        return found[["doc_id", "piece", "shard", "bin", "start", "n_tokens"]]

    return small.groupBy("shard").applyInPandas(pack, "doc_id long, piece long, shard long, bin long, start long, n_tokens long")
