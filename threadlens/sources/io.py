"""Readers and writers.

CSV bodies carry quotes, commas and newlines, so CSV always uses
``multiLine`` with ``"`` as both quote and escape. Parquet is the default
interchange format between stages (column pruning and predicate pushdown
reach the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.sources.schemas import clean_headers, fill_blank_strings, null_missing_tokens

_CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def balance_partitions(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over at least ``min_partitions`` tasks (default: cluster parallelism).

    Text rows are CPU-heavy (regex, tokenising) but small files with few row
    groups plan as very few splits. Only when the scan has fewer partitions
    than cores is a round-robin repartition added; at cluster scale the file
    splits already outnumber the cores and the plan is left untouched.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote (Connect) sessions expose no RDD; keep the plan as is
        return df
    if current < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, path: str, balance: bool = True) -> DataFrame:
    """Parquet scan (pruning and pushdown reach the files), balanced over the cores."""
    df = spark.read.parquet(path)
    return balance_partitions(df) if balance else df


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    keep_blanks: bool = True,
) -> DataFrame:
    """S1 (``keep_blanks``: blanks stay ``""``) / S2 (blanks and missing-value tokens -> null); S3 applied.

    Quoted line feeds make a file one task: land a large table as many files.
    """
    reader = spark.read.options(**_CSV_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema)
    df = clean_headers(reader.csv(path))
    return fill_blank_strings(df) if keep_blanks else null_missing_tokens(df)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV sink of a projected table; array/struct columns JSON-encoded."""
    out = df.select(columns) if columns else df
    conv = {
        f.name: F.to_json(f.name)
        for f in out.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    if conv:
        out = out.withColumns(conv)
    out.write.mode(mode).options(**_CSV_OPTIONS).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink (default stage hand-off)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink (metrics row, nested issue records)."""
    df.write.mode(mode).json(path)
