"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Copies meet in three stages, and each stage groups by the whole normalised text next to its digest, so that equal digests of
different texts never merge:

1. local: the partial aggregate of stage 2 leaves one row per text and input task before anything moves;
2. salted: groups of (digest, salt), the salt being the input task's number, spread a text with any number of copies over ``salts``
   reducers;
3. global: the at most ``salts`` winners of a text combine to the smallest doc_id and the size of the group.

Texts travel once for stage 2 and once, without copies, for stage 3. Members find their class by digest, length and a second
hash in a join without texts, whose skewed keys adaptive execution splits.

Defined cases: a null text counts as empty; an empty table gives an empty result; repeated rows count one by one in group_size
and share kept; a null doc_id never stays while its group has another; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, pick, stored

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    return rows.select("doc_id", "body", digest(F.col("body")).alias("digest"), F.xxhash64("body").alias("second"), F.octet_length("body").alias("size"))


def classes(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct normalised text: digest, second, size, keep_id, group_size."""
    salted = _keyed(docs, digest).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))  # one row a text and input task, whatever the ids
    winners = salted.groupBy("digest", "second", "size", "salt", "body").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n"))
    whole = winners.groupBy("digest", "second", "size", "body").agg(F.min("lead").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.drop("body")


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    members = _keyed(docs, digest).select("doc_id", "digest", "second", "size", sha256(F.col("body")).alias("text_sha256"))
    return members.join(classes(docs, salts, digest), ["digest", "second", "size"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with their columns. Of rows repeated with the same doc_id and text the one with the least other columns stays (as JSON)."""
    none = F.lit(-(2**63))
    kept = classes(docs, salts).select(F.coalesce("keep_id", none).alias("id"), "digest", "second").distinct()
    kept = stored(kept, "exact")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    body = normalised(F.col(f"c{names.index('text')}"))
    keyed = plain.withColumns({"id": F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), none), "digest": sha256(body), "second": F.xxhash64(body)})
    whole = F.struct(*(f"c{i}" for i in range(len(names))))
    others = F.to_json(F.struct(*(f"c{i}" for i, n in enumerate(names) if n != "text")))
    found = keyed.join(kept.hint("merge"), ["id", "digest", "second"], "left_semi").groupBy("id", "digest", "second").agg(F.min_by(whole, others).alias("row")).select("row.*")
    return found.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)
