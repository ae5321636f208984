"""Corpus preparation: five stages from raw documents to sampled token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

1. quality       documents that the quality classifier rejects go
2. lines         boilerplate lines of a source go; ``n_chars`` follows the text
3. near_dups     one document of each near-duplicate group stays
4. benchmark     documents contaminated by a benchmark go
5. pieces        sampled SentencePiece ids, decoded again to prove the round trip
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, line_dedup, near_dedup, quality, sample_pieces
from threadlens.llm.staging import flagged, free_name, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on these documents and their labels; null texts are scored as empty."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = free_name(docs.columns, "quality_check")
    return quality.score(docs, model, out_col=out).filter(F.col(f"{out}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose lines all go stay, with an empty text; a null text stays null."""
    lines, dropped = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_dropped")
    cleaned = line_dedup.line_dedup(docs, site_col="source", lines_col=lines, dropped_col=dropped)
    count = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(count)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links have a similarity of 0.8 or more on five-word shingles. Of a group one
    row of the smallest doc_id stays, of a group without ids one row; texts without
    words are no group."""
    judged = near_dedup.near_dedup(docs, percent=80, with_group=True)
    judged = stage(judged.select("doc_id", "t1", "t2", "near_group", "kept"), "near-judged")
    name = F.struct("doc_id", "t1", "t2")
    several = judged.filter("kept and near_group is not null").groupBy("near_group").agg(F.min(name).alias("least"), F.count(F.lit(1)).alias("n"))
    several = stage(several.filter("n > 1").select("near_group", "least"), "near-several")
    beside = judged.filter("kept").join(several, "near_group").filter(name != F.col("least"))
    gone = judged.filter("not kept").select("doc_id", "t1", "t2").unionByName(beside.select("doc_id", "t1", "t2")).distinct()
    left = _matching(docs, stage(gone, "near-copies"), "left_anti")
    if several.isEmpty():
        return left
    # What stays of these groups has one id and text, maybe on several rows.
    least = several.select("least.*")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = free_name(docs.columns, "text_a"), free_name(docs.columns, "text_b")
    one = _matching(left, least, "left_semi").withColumns({t1: F.xxhash64(text), t2: F.xxhash64(text, F.lit(1))})
    return _matching(left, least, "left_anti").unionByName(one.dropDuplicates(["doc_id", t1, t2]).drop(t1, t2))


def _matching(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_anti or left_semi) with the staged ``names`` (doc_id, t1, t2) by id and text.
    A bit table of fixed size tells most rows that match nothing; they don't move."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hash_col, maybe, i, t1, t2 = (free_name(docs.columns, c) for c in ("text_hash", "maybe", "id_named", "t1_named", "t2_named"))
    rows = flagged(docs.withColumn(hash_col, F.xxhash64(text)), names.withColumn(hash_col, F.col("t1")), hash_col, maybe)
    named = names.toDF(i, t1, t2)
    match = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(hash_col) == F.col(t1)) & (F.xxhash64(text, F.lit(1)) == F.col(t2))
    found = rows.filter(F.col(maybe)).join(named, match, how)
    if how == "left_anti":
        found = rows.filter(~F.col(maybe)).unionByName(found)
    return found.drop(hash_col, maybe)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated: the hit words are 5 % of the document's words or more."""
    out = free_name(docs.columns, "decon")
    judged = decontaminate.annotate(docs, _table(spark, sf_dir, "benchmark"), out_col=out)
    return judged.filter(~F.col(f"{out}.contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids (null for a null text), n_pieces, and whether decoding gave the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    rows = stage(sample_pieces.encode(texts, path, keep_text=False), "pieces")
    return sample_pieces.decode(rows, path).select(
        "doc_id",
        "piece_ids",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("lossless"),
    )


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_dups", near_dups_stage),
    ("benchmark", benchmark_stage),
    ("pieces", pieces_stage),
]

#: The classifier, the sketches and the sampler have no SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
