"""The registered queries over these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .exact import exact_dedup
from .extraction import extracted
from .language import language_id
from .packing import packed
from .pii import secret, surrogates
from .quality import quality
from .repeats import without_repeats
from .shared import table
from .simhash import near_duplicates
from .urls import url_filter

def tokenizer() -> str:
    """The production vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": lambda spark, d: packed(table(spark, d, "documents"), vocabulary=tokenizer()),
    "op2_html_extraction": lambda spark, d: extracted(table(spark, d, "pages")),
    "op3_bpe": lambda spark, d: round_trip(table(spark, d, "documents"), tokenizer()),
    "op4_suffix_array_dedup": lambda spark, d: without_repeats(table(spark, d, "documents")),
    "op5_exact_dedup": lambda spark, d: exact_dedup(table(spark, d, "documents")),
    "op6_simhash_dedup": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op7_url_filter": lambda spark, d: url_filter(table(spark, d, "pages")),
    "op8_pii_surrogates": lambda spark, d: surrogates(table(spark, d, "documents"), secret(spark)),
    "op9_language_id": lambda spark, d: language_id(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               coalesce(doc_id = min(doc_id) OVER same, false) AS kept, sha256(body) AS text_sha256
        FROM rows WINDOW same AS (PARTITION BY body)
    """,
}
