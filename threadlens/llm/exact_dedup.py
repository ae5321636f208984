"""Exact deduplication by skew-safe combining.

Copies are combined in three stages, and each stage groups by the full
normalised text beside its digest, so equality is always equality of content:

1. local: the map-side half of the salted aggregation combines the copies that
   one task reads;
2. salted: ``(digest, salt, text)`` groups, so a text that a third of all rows
   share is spread over ``salts`` reducers;
3. global: the at most ``salts`` winners of a text are combined.

Only the narrow winners ``(digest, check hash, keep_id, n)`` of repeated texts
return to the rows; a row whose text is unique is its own winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.staging import stage

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are copies of each other and of empty texts.
    ``keep_id`` is the group's smallest non-null id. A null id is kept only if
    no row of its group has an id. Rows that repeat an id and its text share
    one fate, as no column tells them apart. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content")
    )
    keyed = rows.select(
        "doc_id",
        "content",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.xxhash64("content").alias("check"),
    )
    salted = keyed.groupBy(
        "digest", "check", "content", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    ).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = (
        salted.groupBy("digest", "check", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        .filter("n > 1")
        .select("digest", "check", "keep_id", "n")
    )
    groups = stage(groups, "exact-groups")
    return (
        keyed.select("doc_id", "digest", "check")
        .join(groups, ["digest", "check"], "left")
        .select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("n").isNull(), F.lit(True))
            .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
