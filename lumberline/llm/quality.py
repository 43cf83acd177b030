"""Quality rules with adaptive thresholds.

Counts come from the whole text of every row. A base rule fails rows of under 10 words or with over a fifth of their words in
repeated windows of five. The other rows are held against thresholds of their language and source: mergeable quantile sketches
(Spark's percentile_approx, whose partial sketches merge across tasks) of each measure over all rows that pass the base rule,
and a measure fails beyond the upper quartile by ``WIDTH`` interquartile ranges (at least the measure's floor), the mean word
length also below the lower. Groups of under ``FEW`` rows use the sketch of their language, and languages of under ``FEW`` that
of all rows. Verdicts come from a join of measures with thresholds; measures are stored first, so that texts are read once.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources are groups of their own;
repeated rows get equal verdicts; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, stored

LEAST_WORDS = 10
WINDOW = 5
REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
ACCURACY = 10_000
WIDTH = 6.0
FEW = 30
#: Measure: its value from the counts, the least interquartile range, whether low values fail too. The least range decides where the
#: quartiles coincide: ordinary prose has no symbols, but good rows do repeat lines and words.
MEASURES = {
    "symbol_share": (F.expr, "n_symbols / word_chars", 0.005, False),
    "dup_line_share": (F.expr, "n_dup_lines / n_lines", 0.05, False),
    "repeat_share": (F.expr, "n_repeat_words / n_words", 0.02, False),
    "word_length": (F.expr, "word_chars / n_words", 0.5, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found twice or more."""
    if len(words) <= WINDOW:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-WINDOW].tolist()]
    windows = [line[a:b] for a, b in zip(starts, (ends[WINDOW - 1 :] - 1).tolist(), strict=True)]
    if len(set(windows)) == len(windows):
        return 0
    first: dict[bytes, int] = {}
    inside = np.zeros(len(words) + 1, np.int32)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            for k in (i, j):
                inside[k] += 1
                inside[min(k + WINDOW, len(words))] -= 1
    return int((np.cumsum(inside)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    whole = (text or "").encode("utf-8", "surrogatepass")
    words = whole.split()
    blank = len(whole) - len(whole.translate(None, BLANKS))
    lines = [x for x in whole.split(b"\n") if x.strip()]
    return len(words), len(text or "") - blank, len(whole) - len(whole.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counts(t.as_py()) for t in b["text"]], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], b["source"], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", "lang", "source", *COUNTS])

    rows = pick(docs, "doc_id", "text", "lang", "source").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(each, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def _thresholds(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """low and high of each measure as columns of a struct, for groups of enough rows."""
    sketches = [F.percentile_approx(m, [0.25, 0.75], ACCURACY).alias(m) for m in MEASURES]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sketches).where(F.col("n") >= (FEW if keys else 1))
    ends = []
    for m, (_, _, floor, both) in MEASURES.items():
        reach = WIDTH * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(floor))
        ends += [(F.col(m)[0] - reach if both else F.lit(float("-inf"))).alias(f"{m}_low"), (F.col(m)[1] + reach).alias(f"{m}_high")]
    return groups.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*ends).alias(name))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    rows = stored(measured(docs).withColumn("base_failed", base_failed()), "measures")
    for m, (make, value, _, _) in MEASURES.items():
        rows = rows.withColumn(m, F.when(~F.col("base_failed"), make(value)))
    passed = rows.where(~F.col("base_failed"))
    own = _thresholds(passed, ["lang", "source"], "own")
    lang = _thresholds(passed, ["lang"], "same")
    every = _thresholds(passed, [], "every")
    joined = rows.join(own, rows.lang.eqNullSafe(own.own_lang) & rows.source.eqNullSafe(own.own_source), "left")
    joined = joined.join(lang, joined.lang.eqNullSafe(lang.same_lang), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    ends = F.coalesce("own", "same", "every")
    fits = reduce(lambda a, b: a & b, (F.col(m).between(ends[f"{m}_low"], ends[f"{m}_high"]) for m in MEASURES))
    return joined.select("doc_id", *COUNTS[:-1], "base_failed", F.coalesce(~F.col("base_failed") & fits, F.lit(False)).alias("kept"))
