"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A staged table cuts the lineage: later steps re-read files that every executor
sees, so a lost executor costs the tasks it ran and nothing more.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import ensure_checkpoint_dir

BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the re-read table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to BATCH_BYTES, so that a task with
    long texts holds a few of them at a time on either side; returns ``df``."""
    ship_package(df.sparkSession)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(str(conf.get(name)).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path has it already."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _shipped or any(p and Path(p).resolve() == root for p in paths):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='threadlens-')}/threadlens", "zip", root, "threadlens")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened until it is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Bits of the table that thins rows before a join: 16 MB, whatever is joined.
THIN_BITS = 1 << 27


def _bit_table(wanted: DataFrame, key: str) -> np.ndarray:
    """Words of THIN_BITS bits, one set for each hash ``key`` (a long) of ``wanted``."""
    word = F.col(key).bitwiseAND(F.lit(THIN_BITS - 1))
    one = F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")
    found = wanted.groupBy(F.shiftright(word, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(THIN_BITS // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def flagged(rows: DataFrame, wanted: DataFrame, key: str, flag: str, unless: DataFrame | None = None) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where the hash ``key`` (a long) is not in
    ``wanted``, or may be in ``unless``.

    A bit table of a fixed size is shipped to the tasks, so a join that follows
    needn't move the rows without the flag; the larger ``wanted`` is, the more
    rows have it. With the false hits of ``wanted`` as ``unless``, the flag
    tells no row wrongly and misses few.
    """
    tables = [_bit_table(t, key) for t in (wanted, unless) if t is not None]
    column, names = rows.columns.index(key), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(column).to_numpy().view(np.uint64) & np.uint64(THIN_BITS - 1)
            hits = [(t[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool) for t in tables]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits[0] & ~hits[1] if len(hits) > 1 else hits[0])], [*names, flag])

    return bound_batches(rows).mapInArrow(run, T.StructType([*rows.schema, T.StructField(flag, T.BooleanType())]))


def thinned(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose hash ``key`` is not in ``wanted``."""
    flag = free_name(rows.columns, "wanted")
    return flagged(rows, wanted, key, flag).filter(F.col(flag)).drop(flag)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/llm/" in path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
