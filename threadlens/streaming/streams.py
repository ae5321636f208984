"""Streaming queries over landing folders (append-only sources and sinks)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.functions.cues import WORKAROUND, CueDictionary, heuristic_score
from threadlens.session import ensure_checkpoint_dir
from threadlens.sources.ingest import flatten_issues
from threadlens.sources.schemas import API_RESPONSES


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Per-query checkpoint location inside the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def issue_stream(
    spark: SparkSession,
    landing_dir: str,
    sink_dir: str,
    name: str = "issues",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """I1 + I2 on landed response files (JSON lines of ``API_RESPONSES``).

    Each new response file becomes flat issue rows appended to ``sink_dir``
    (Parquet, partitioned by repository). Exactly-once through the file sink's
    metadata log and the query checkpoint.
    """
    reader = spark.readStream.schema(API_RESPONSES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.json(landing_dir)
    issues = flatten_issues(pages)
    writer = (
        issues.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", stream_checkpoint(spark, name))
        .partitionBy("repository")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def collect_stream(
    spark: SparkSession,
    landing_dir: str,
    sink_dir: str,
    name: str = "collected",
    repeat_delay: str = "2 days",
    available_now: bool = True,
) -> StreamingQuery:
    """Incremental collection (an extension): each version of an issue is appended once.

    Crawls overlap, so pages land again. Event time is the landing time of a
    page's file; a version (key, ``updated_at`` and content) that lands again
    within ``repeat_delay`` is dropped by a keyed state that the watermark
    bounds. A version that is delivered later than that is appended again, and
    ``latest_issues`` shows it once all the same. A file whose time stamp is
    older than the watermark counts as late and is left out. A stopped query
    continues from its checkpoint under the same ``name``.
    """
    pages = spark.readStream.schema(API_RESPONSES).json(landing_dir)
    pages = pages.withColumn("landed_at", F.col("_metadata.file_modification_time"))
    issues = flatten_issues(pages)
    content = [c for c in issues.columns if c != "landed_at"]
    versions = (
        issues.withColumn("version", F.xxhash64(*content))
        .withWatermark("landed_at", repeat_delay)
        .dropDuplicatesWithinWatermark(["repository", "issue_number", "updated_at", "version"])
    )
    writer = (
        versions.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", stream_checkpoint(spark, name))
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_issues(versions: DataFrame) -> DataFrame:
    """The newest version of each issue: by ``updated_at``, then by landing time.

    One aggregation with map-side combine; an issue with very many versions
    reaches the shuffle as one row per task.
    """
    keys = ["repository", "issue_number"]
    rest = [c for c in versions.columns if c not in (*keys, "updated_at", "landed_at", "version")]
    newest = F.max(F.struct("updated_at", "landed_at", "version", *rest)).alias("_v")
    return versions.groupBy(*keys).agg(newest).select(*keys, F.col("_v.updated_at").alias("updated_at"), *[F.col(f"_v.{c}").alias(c) for c in rest])


def cue_stream(
    spark: SparkSession,
    threads_dir: str,
    sink_dir: str,
    schema,
    dictionary: CueDictionary = WORKAROUND,
    name: str = "thread_cues",
    available_now: bool = True,
) -> StreamingQuery:
    """T8 on a stream of assembled threads: score and matched cue names per row."""
    threads = spark.readStream.schema(schema).parquet(threads_dir)
    scored = heuristic_score(threads, "thread_text", dictionary)
    writer = (
        scored.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", stream_checkpoint(spark, name))
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def score_stream(
    spark: SparkSession,
    detector_path: str,
    threads_dir: str,
    sink_dir: str,
    schema,
    id_col: str = "annotation_id",
    name: str = "thread_scores",
    available_now: bool = True,
) -> StreamingQuery:
    """M12 on a stream: the saved detector scores new threads row by row.

    Scoring is a stateless projection, so the file sink's log and the query
    checkpoint write each row exactly once.
    """
    from threadlens.operators.model import load_detector, score

    det = load_detector(spark, detector_path)
    threads = spark.readStream.schema(schema).parquet(threads_dir)
    writer = (
        score(det, threads, id_col).writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", stream_checkpoint(spark, name))
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
