"""The registered queries of this package: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that the URL filter gets here: canonical URLs of the pages whose
    document (the number that ends a page's path) is labelled toxic."""
    from threadlens.llm.url_filter import canonical_url, url_host, url_path

    pages = _table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    return (
        pages.withColumn("doc_id", F.expr(r"try_cast(regexp_extract(path, '([0-9]+)(\\.html)?/*$', 1) as bigint)"))
        .join(toxic, "doc_id", "left_semi")
        .select(canonical_url(F.col("host"), F.col("path")).alias("url"))
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages"), toxic_page_urls(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text",
        F.col("dedup_lines").cast("long").alias("n_lines"), F.col("dedup_dropped").cast("long").alias("n_dropped"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents")).drop("t1", "t2")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.language_id import fit, in_training, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id",
        F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.decontaminate import annotate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, _table(spark, sf_dir, "benchmark"), keep_text=False).select("doc_id", "decon.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model, keep_text=False).select("doc_id", "quality_check.*")


def op9_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from threadlens.llm.sample_pieces import decode, encode
    from threadlens.llm.staging import stage

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    pieces = stage(encode(docs, path, keep_text=False), "pieces")
    return decode(pieces, path).select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.crc32(F.array_join("piece_ids", ",").cast("binary")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("lossless"),
    )


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from threadlens.llm.huffman_ids import encode_corpus, read_ids

    path = encode_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.whitening import fit, identity_error, whiten

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    error = identity_error(rows, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    return (
        whiten(rows, model, keep_vector=False)
        .select("vec_id", F.col("whitening.deviation").alias("deviation"), F.posexplode("whitening.whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2
    removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.conversation_repair import repair

    conversations = _table(spark, sf_dir, "conversations")
    found = repair(damaged_conversations(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.llm.signature_join import signature_join

    return signature_join(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_line_dedup,
        op3_near_dedup,
        op4_suffix_dedup,
        op5_language_id,
        op6_decontaminate,
        op7_exact_dedup,
        op8_quality,
        op9_sample_pieces,
        op10_token_ids,
        op11_whiten,
        op12_repair_conversations,
        op13_signature_join,
    )
}
