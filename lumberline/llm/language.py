"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters of the lower-cased text stay, every run of other characters becomes one space, and n-grams of 1 to 3 characters are
hashed to ``buckets`` counters. Training counts n-grams per language in Spark over a bounded, documented sample of labelled
rows (``per_lang`` rows of each language in expectation, all where there are fewer, chosen by a hash of doc_id). The matrix of
log probabilities has at most ``max_langs`` x ``buckets`` cells, a bound that does not grow with the input, and is broadcast;
scoring takes the texts of an Arrow batch as sparse rows of n-grams and gathers and sums the matrix's cells in numpy, over whole texts,
in pieces of bounded size.

Defined cases: a null or empty text, or one without any letter, is ``und`` with score 0; with no labelled row at all every text
is ``und``; ties go to the first language in alphabetical order; more than ``max_langs`` languages raise ValueError; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick

BUCKETS = 1 << 16
PER_LANG = 2000
MAX_LANGS = 512
NGRAMS = (1, 2, 3)
PIECE = 1 << 20
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    found = np.zeros(0x110000, dtype=bool)
    found[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return found


def codes(text: str) -> np.ndarray:
    """Code points of the letters, runs of anything else as one space, a space at either end; empty if there is no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.empty(0, np.uint32)
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp = np.concatenate(([np.uint32(32)], cp[keep], [np.uint32(32)]))
    if cp[1] == 32:
        cp = cp[1:]
    return cp[:-1] if cp[-2] == 32 else cp


def features(cp: np.ndarray, buckets: int, seen: int = 0) -> np.ndarray:
    """Bucket of every n-gram that is not a lone space and doesn't end in the first ``seen`` characters."""
    h1 = (cp * np.uint32(0x9E3779B1)) ^ (cp >> np.uint32(7))
    parts, h = [], h1
    for n in NGRAMS:
        if n > 1:
            if len(cp) < n:
                break
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ h1[n - 1 :] ^ (h[:-1] >> np.uint32(15))
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        at = (mixed >> np.uint32(8)) & np.uint32(buckets - 1)
        new = max(0, seen - n + 1)
        parts.append(at[new:][cp[new:] != 32] if n == 1 else at[new:])
    return np.concatenate(parts)


def _pieces(cp: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Features in pieces of bounded size; a piece begins two characters early, and each n-gram counts once."""
    for i in range(0, len(cp), PIECE):
        seen = min(i, max(NGRAMS) - 1)
        yield features(cp[i - seen : i + PIECE], buckets, seen)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: sparse rows of n-grams, one after the other, times the matrix, in pieces of bounded size."""
        rows, parts, held = [], [], 0
        told = np.zeros(len(texts), bool)
        totals = np.tile(self.prior, (len(texts), 1))

        def multiply() -> None:
            nonlocal rows, parts, held
            if held:
                first = np.cumsum([0, *(len(p) for p in parts[:-1])])
                at = np.concatenate(parts)
                for k, weights in enumerate(self.weights):
                    np.add.at(totals[:, k], rows, np.add.reduceat(np.take(weights, at), first, dtype=np.float64))
            rows, parts, held = [], [], 0

        for i, text in enumerate(texts if self.langs else ()):
            cp = codes(text) if text else ()
            told[i] = len(cp) > 0
            for at in _pieces(cp, self.weights.shape[1]) if told[i] else ():
                if len(at):
                    rows.append(i)
                    parts.append(at)
                    held += len(at)
                if held >= PIECE:
                    multiply()
        multiply()
        best = totals.argmax(axis=1) if self.langs else np.zeros(len(texts), np.int64)
        scores = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1) if self.langs and len(texts) else np.zeros(len(texts))
        return [(self.langs[b], float(s)) if t else (UND, 0.0) for t, b, s in zip(told.tolist(), best.tolist(), scores.tolist(), strict=True)]


def train(docs: DataFrame, buckets: int = BUCKETS, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().limit(max_langs + 1).collect())
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return Model([], np.empty((0, buckets), np.float32), np.empty(0))
    rate = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, per_lang / n))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                cp = codes(text or "")
                if len(cp):
                    for at in _pieces(cp, buckets):
                        seen.setdefault(lang, np.zeros(buckets, np.int64))[:] += np.bincount(at, minlength=buckets)
        for lang, n in sorted(seen.items()):
            at = n.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = counted.toPandas()  # at most max_langs x buckets cells
    langs = [lang for lang, _ in sizes]
    matrix = np.zeros((len(langs), buckets))
    place = {lang: i for i, lang in enumerate(langs)}
    if len(cells):
        matrix[cells["lang"].map(place).to_numpy(), cells["bucket"].to_numpy()] = cells["n"].to_numpy()
    smooth = matrix + 0.5
    weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
    docs_n = np.array([n for _, n in sizes], dtype=np.float64)
    return Model(langs, weights, np.log((docs_n + 1) / (docs_n + 1).sum()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, **options: int) -> DataFrame:
    return identify(docs, train(docs, **options))


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more, with their columns; ``und`` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(b[f"c{at}"].to_pylist())
            yield b.filter(pa.array([lang != UND and not math.isnan(s) and s >= least for lang, s in found], pa.bool_()))

    return plain.mapInArrow(choose, plain.schema).toDF(*names)
