"""A corpus pipeline: language ID, exact duplicates, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; run() writes each
stage's result as Parquet in the shared folder and rereads it as the next one's docs; a stage's result is deleted when its
successor's is written.

Defined cases: rows with a null text, or without a letter, go in the first stage; a null doc_id stays only where its text has no
other; rows with the same doc_id and text leave one (the least by its other columns); extra columns are carried to the last stage;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumberline.llm.exact import without_copies
from lumberline.llm.language import identified, train
from lumberline.llm.packing import packed
from lumberline.llm.pii import anonymised, secret
from lumberline.llm.shared import discard, stored, table
from lumberline.llm.simhash import without_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts of which no language has half the probability, go."""
    return identified(docs, train(table(spark, sf_dir, "documents")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return anonymised(docs, secret(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("pii_surrogates", private), ("best_fit_packing", packing)]
#: A classifier, connected components and keyed surrogates: SQL has no such rows; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not docs and hasattr(before, "stored_at"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
