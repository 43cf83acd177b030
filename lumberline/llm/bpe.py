"""Byte-level BPE, encoding and decoding.

A text is cut at the vocabulary's added tokens, then into pieces by its pattern. Within a piece the symbols form a doubly linked
list; a priority queue holds the merge ranks of neighbours, the least rank and of equal ranks the leftmost first, and an entry
whose neighbours have changed since is stale and skipped. Decoding concatenates the vocabulary's byte strings. Pieces recur, so
that each worker remembers those it has merged, up to ``REMEMBERED`` of them and none over ``SHORT`` characters (which bounds the
bytes that it holds), the younger half in full and of the older half those that recur; results never depend on it. Who needs numbers
of tokens only takes ``Counts``.

The vocabulary file is a parameter: it is read on the driver and broadcast, and its size doesn't depend on the input. Files with
another kind of model, normaliser or splitting than byte-level BPE's are refused with ValueError.

Defined cases: a null text counts as empty and has no tokens; very long pieces take n log n steps; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

REMEMBERED = 1_000_000
SHORT = 32
TOKENS = 1 << 18
TOGETHER = 1 << 23
# Fixed value: the pattern of byte-level BPE.
PIECES = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?(?:\p{N}+|[^\p{White_Space}\p{L}\p{N}]+)|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = 1 << 62
EDGE = 1 << 40
UNCUT = re.compile(r"\s (?!\S)").search


_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


def packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe(dict):
    """Maps a piece to its ids as packed little-endian unsigned 32-bit integers; computes what it doesn't remember."""

    def __init__(self, spec: str):
        super().__init__()
        self.spec, self.older = spec, {}
        told = json.loads(spec)
        model, letters, split = told["model"], byte_letters(), told.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not told.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "dropout")):
            raise ValueError("the file's model is not plain byte-level BPE")
        vocab = model["vocab"]
        self.strings = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]))
        for word, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in word)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        for word, i in self.added.items():
            self.strings[i] = word.encode()
        single = {letters[w]: i for w, i in vocab.items() if len(w) == 1}
        self.single = [single.get(b, -1) for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.bits = len(self.strings).bit_length()
        self.merges = {vocab[a] << self.bits | vocab[b]: rank << self.bits | vocab[a + b] for rank, (a, b) in enumerate(pairs, 1)}
        self.starts = [[self.merges.get(a << self.bits | b, 0) if a >= 0 <= b else 0 for b in self.single] for a in self.single]
        self.find = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def __reduce__(self):
        return Bpe, (self.spec,)

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = packed(self.merged(piece.encode("utf-8", "surrogatepass")))
            if len(piece) > SHORT:
                return found
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Symbols after all merges. A merge is rank << bits | id, a queue entry merge << places | position of its left symbol.

        ``wanted`` has the merge of each symbol with the next as it is now: an entry that differs from it is stale.
        """
        n, bits, look, starts, single = len(piece), self.bits, self.merges.get, self.starts, self.single
        symbol = [single[b] for b in piece]
        wanted = [starts[a][b] for a, b in pairwise(piece)]
        places = n.bit_length()
        queue = [m << places | i for i, m in enumerate(wanted) if m]
        if not queue:
            return symbol
        heapify(queue)
        wanted.append(0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        low, here = (1 << bits) - 1, (1 << places) - 1
        while queue:
            entry = heappop(queue)
            i, merge = entry & here, entry >> places
            if wanted[i] != merge:
                continue
            new = symbol[i] = merge & low
            j = after[i]
            symbol[j], wanted[j] = -1, 0
            k = after[i] = after[j]
            merge = 0
            if k < n:
                before[k] = i
                merge = look(new << bits | symbol[k], 0)
                if merge:
                    heappush(queue, merge << places | i)
            wanted[i] = merge
            h = before[i]
            if h >= 0:
                merge = wanted[h] = look(symbol[h] << bits | new, 0)
                if merge:
                    heappush(queue, merge << places | h)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of the text, packed."""
        look = self.__getitem__
        if self.cut is None or not any(a in text for a in self.added):
            return b"".join(map(look, self.find(text)))
        parts = []
        for part in self.cut(text):
            if part in self.added:
                parts.append(packed([self.added[part]]))
            else:
                parts += map(look, self.find(part))
        return b"".join(parts)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The text's bytes, in parts."""
        strings = self.strings
        for i in range(0, len(ids), 4 * TOKENS):
            yield b"".join([strings[t] for t in np.frombuffer(ids[i : i + 4 * TOKENS], dtype="<u4").tolist()])


class Counts:
    """Numbers of tokens, for those who don't need the ids: each distinct word of some texts is merged once, many words at a time.

    A word is what lies between two spaces, and goes with the space before it. A text may be cut before a space unless white space
    comes before it and more white space, or the end, after it: no piece has a space behind anything else but white space, and a
    run of white space leaves its last character to what follows. Words that white space begins or ends, and empty ones, count
    ``EDGE`` on top, and texts with any are searched for such a space; if there is one, or an added token, the text is encoded as
    a whole. Words up to ``SHORT`` are remembered as pieces are, ``REMEMBERED`` at most.
    """

    def __init__(self, ids: Bpe):
        self.ids, self.younger, self.older = ids, {}, {}
        self.starts = np.array([[m or NONE for m in row] for row in ids.starts])
        self.single = np.array(ids.single)
        self.pairs = np.array([*sorted(ids.merges), NONE])
        self.merges = np.array([*(ids.merges[x] for x in self.pairs[:-1].tolist()), NONE])

    def __reduce__(self):
        return Counts, (self.ids,)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << self.ids.bits | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merges[at], NONE)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """As many symbols as ``Bpe.merged`` finds, of each piece. Pieces of one length are the rows of a table; each round merges
        the leftmost least pair of every row, and so takes one column away, and rows without a pair to merge leave."""
        sizes = np.array([len(p) for p in pieces])
        out = np.minimum(sizes, 1)
        for size in np.unique(sizes[sizes > 1]).tolist():
            who = (sizes == size).nonzero()[0]
            raw = np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), np.uint8).reshape(-1, size)
            symbol, wanted = self.single[raw], self.starts[raw[:, :-1], raw[:, 1:]]
            while len(who):
                width = symbol.shape[1]
                out[who] = width
                if width == 1:
                    break
                at = wanted.argmin(axis=1)
                merge = wanted[np.arange(len(who)), at]
                live = (merge != NONE).nonzero()[0]
                who, symbol, wanted, at, merge = who[live], symbol[live], wanted[live], at[live], merge[live]
                row, stay = np.arange(len(who)), np.ones(symbol.shape, bool)
                symbol[row, at] = merge & (1 << self.ids.bits) - 1
                stay[row, at + 1] = False
                symbol = symbol[stay].reshape(len(who), width - 1)
                wanted = wanted[stay[:, 1:]].reshape(len(who), width - 2)
                for first in (at - 1, at):
                    some = ((first >= 0) & (first < width - 2)).nonzero()[0]
                    left = first[some]
                    wanted[some, left] = self.merge_of(symbol[some, left], symbol[some, left + 1])
        return out

    def sizes(self, words: list[str]) -> np.ndarray:
        """Tokens of each word with a space before it."""
        found = list(map(self.younger.get, words))
        new = [i for i, n in enumerate(found) if n is None]
        pieces, owner, rest = [], [], []
        for i in new:
            word = words[i]
            n = found[i] = self.older.get(word)
            if n is not None:
                continue
            found[i] = 0 if word and not word[0].isspace() and not word[-1].isspace() else EDGE
            rest.append(i)
            for p in (" " + word,) if word.isascii() and word.isalpha() else self.ids.find(" " + word):
                if len(p) > SHORT:
                    found[i] += len(self.ids[p]) // 4
                else:
                    pieces.append(p.encode())
                    owner.append(i)
        out = np.array(found, np.int64)
        np.add.at(out, np.array(owner, np.int64), self.merged(pieces))
        for i, n in zip(new, out[new].tolist(), strict=True):
            if len(words[i]) <= SHORT:
                self.younger[words[i]] = n
        if len(self.younger) >= REMEMBERED // 2:
            self.older, self.younger = self.younger, {}
        return out

    def count(self, texts: pa.Array) -> list[int]:
        """Tokens of each text; ``TOGETHER`` bytes, or one text, at a time."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TOGETHER
        cuts = [0, *((size[1:] != size[:-1]).nonzero()[0] + 1).tolist(), len(texts)]
        return [n for a, z in pairwise(cuts) if a < z for n in self._count(pc.fill_null(texts.slice(a, z - a), ""))]

    def _count(self, texts: pa.Array) -> list[int]:
        parts = pc.split_pattern(texts, " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        words = parts.flatten()
        told = words.dictionary_encode()
        sizes = self.sizes(told.dictionary.to_pylist())[told.indices.to_numpy()]
        sizes[first] = [len(self.ids.encode(x)) // 4 for x in words.take(pa.array(first)).to_pylist()]
        out = np.add.reduceat(sizes, first)
        whole = out >= EDGE
        out %= EDGE
        for i in whole.nonzero()[0].tolist():
            whole[i] = UNCUT(texts[i].as_py()) is not None
        for word in self.ids.added:
            whole |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        for i in whole.nonzero()[0].tolist():
            out[i] = len(self.ids.encode(texts[i].as_py())) // 4
        return out.tolist()


def vocabulary(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(f.read())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers) and n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [shared.value.encode(t.as_py() or "") for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return _texts(docs).mapInArrow(each, "doc_id long, ids binary, n_tokens long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from its ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def one(text: str | None) -> tuple[int, str, str]:
        ids, text_hash = shared.value.encode(text or ""), hashlib.sha256()
        for part in shared.value.decode(ids):
            text_hash.update(part)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), text_hash.hexdigest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, texts = zip(*map(one, (t.as_py() for t in b["text"])), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
