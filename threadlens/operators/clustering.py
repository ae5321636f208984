"""Clustering of similar workarounds by their embeddings: oversampled seeding, then Lloyd rounds.

An extension: the surveyed product names it as a next step. Vectors stay where
they are; each round reads them once. A task sends sums and counts per centre,
which Spark adds up, so the driver only ever holds the centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose distances to all centres a task holds at a time.
BLOCK_ROWS = 1024


@dataclass
class Centres:
    """``points[i]`` is the centre that grew from the row with id ``ids[i]``."""

    ids: list[int]
    points: np.ndarray


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows with a finite vector of the commonest length (the longer one of a tie).

    Rows with a null id, a null or empty vector or a null, NaN or infinite
    entry are left out, as no distance to them is defined.
    """
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("id is not null and v is not null and size(v) > 0").filter(finite)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (top["d"] if top else 0))


def draw(key: Column, salt: int) -> Column:
    """A number from 0 to 1 that depends on key and salt alone, from md5 (as SQL can)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(salt)))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _blocks(batch: pa.RecordBatch, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, nearest centre, distance) in blocks; of equally near centres the first."""
    ids = batch.column(0).to_numpy()
    x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
    for a in range(0, len(ids), BLOCK_ROWS):
        rows = x[a : a + BLOCK_ROWS]
        distance = np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in points], axis=1)
        nearest = distance.argmin(axis=1)
        yield ids[a : a + BLOCK_ROWS], rows, nearest, distance[np.arange(len(rows)), nearest]


def assign(vectors: DataFrame, centres: Centres) -> DataFrame:
    """(id, cluster, distance): the id that the nearest centre grew from; ties go to the least id."""
    names = np.array(centres.ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, nearest, distance in _blocks(batch, centres.points):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names[nearest]), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster long, distance double")


def _sums(vectors: DataFrame, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """Members and sums of the members of each centre."""
    k, dim = centres.points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k), np.zeros((k, dim))
        for batch in batches:
            for _, rows, nearest, _ in _blocks(batch, centres.points):
                n += np.bincount(nearest, minlength=k)
                np.add.at(total, nearest, rows)
        entries = np.concatenate([n[:, None], total], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(entries))), pa.array(entries)], ["at", "s"])

    found = vectors.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    entries = np.zeros(k * (dim + 1))
    entries[found.column(0).to_numpy()] = found.column(1).to_numpy()
    entries = entries.reshape(k, dim + 1)
    return entries[:, 0], entries[:, 1:]


def seed_centres(vectors: DataFrame, k: int, rounds: int, oversample: int, salt: int) -> Centres:
    """Seeds by oversampling: each round draws about ``oversample`` vectors by their squared
    distance to the seeds so far; the ``k`` seeds with most members stay (ties: least id)."""
    first = vectors.orderBy(draw(F.col("id"), salt), "id").limit(1).collect()
    if not first:
        return Centres([], np.zeros((0, 0)))
    found = {first[0]["id"]: first[0]["v"]}
    for r in range(1, rounds + 1):
        own = _sorted(found)
        far = assign(vectors, own).withColumn("w", F.col("distance") * F.col("distance"))
        total = far.agg(F.sum("w")).first()[0]
        if not total:
            break
        drawn = far.filter(draw(F.col("id"), salt + r) < F.col("w") * (oversample / total)).select("id")
        # About oversample rows: a bounded broadcast and a bounded collect.
        found |= {row["id"]: row["v"] for row in vectors.join(F.broadcast(drawn), "id", "left_semi").dropDuplicates(["id"]).collect()}
    own = _sorted(found)
    members, _ = _sums(vectors, own)
    best = sorted(range(len(own.ids)), key=lambda i: (-members[i], own.ids[i]))[:k]
    return _sorted({own.ids[i]: own.points[i] for i in best})


def _sorted(found: dict) -> Centres:
    ids = sorted(found)
    return Centres(ids, np.array([found[i] for i in ids], float))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 5, seed_rounds: int = 3, oversample: int | None = None, salt: int = 42) -> Centres:
    """Centres of the (id, v) rows of ``usable_vectors``, of at most ``k`` clusters.

    A centre without members stays where it is. Stops early when no centre
    moves. No rows give no centres; repeated ids count as rows of their own.
    """
    centres = seed_centres(vectors, k, seed_rounds, oversample or 2 * k, salt)
    for _ in range(rounds if len(centres.ids) else 0):
        members, sums = _sums(vectors, centres)
        moved = np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], centres.points)
        if np.array_equal(moved, centres.points):
            break
        centres = Centres(centres.ids, moved)
    return centres


def clusters(df: DataFrame, id_col: str, vec_col: str, **options) -> DataFrame:
    """(id_col, cluster, distance) of every usable row."""
    vectors = usable_vectors(df, id_col, vec_col)
    centres = cluster(vectors, **options)
    if not centres.ids:
        schema = T.StructType.fromDDL("id long, cluster long, distance double")
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return assign(vectors, centres).withColumnRenamed("id", id_col)


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """Members, mean distance and radius of each cluster."""
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("radius")
    )


