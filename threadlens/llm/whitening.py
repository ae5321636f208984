"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then
one-sided Jacobi on the triangular factor.

Vectors are quantised to integers, so counts and sums are exact. One pass sums
each dimension, a second one adds up the scatter of the centred vectors: every
task sends one matrix triangle, which Spark sums by entry. The driver gets the
sums and the triangle, whose size depends on the dimension alone.

There the scatter is factored as P L L' P' with diagonal pivots, and plane
rotations from the right make the columns of L orthogonal. Their squared norms
are the scatter's eigenvalues and the normalised columns its eigenvectors; the
scatter itself is never rotated, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.staging import bound_batches, free_name

#: A pivot below this share of the first one ends the factorisation: what is left is rounding.
RANK = 1e-9
SWEEPS = 60
_LONG = 1 << 62


@dataclass(frozen=True)
class Grid:
    """An entry c counts as floor(scale * c) + offset."""

    scale: float = 64.0
    offset: int = 1_000_000


@dataclass
class Whitener:
    grid: Grid
    dim: int
    n: int
    sums: list[int]
    components: np.ndarray  # components x dim, unit rows by falling eigenvalue
    eigenvalues: np.ndarray  # of the covariance, divisor n
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else self.eigenvalues


def _integers(column: pa.Array, grid: Grid, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, lengths and flat entries of the usable vectors (of length ``dim``)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    # Null entries are told by the validity bits; a null vector may have any length.
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    entry_ok = np.asarray(flat.is_valid())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) * grid.scale
    entry_ok = entry_ok & (np.abs(values) < _LONG)  # false for NaN
    bad = np.concatenate([[0], np.cumsum(~entry_ok)])
    ends = np.cumsum(lengths)
    ok = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - lengths]) & (lengths > 0)
    if dim is not None:
        ok &= lengths == dim
    mine = np.repeat(ok, lengths)
    return np.flatnonzero(ok), lengths[ok], np.floor(values[mine]).astype(np.int64) + grid.offset


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; Python integers where a long is too short."""
    largest = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    if largest * n + max((abs(s) for s in sums), default=0) < _LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(scaled: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; null beyond a long."""
    if not scaled.size:
        return []
    if scaled.dtype != object:
        rough = (scaled.astype(np.float64) ** 2).sum(axis=1)
        if rough.max() < _LONG:
            return (scaled**2).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in scaled]
    return [v if v < 1 << 63 else None for v in exact]


def _count(docs: DataFrame, grid: Grid) -> tuple[int, int, list[int]]:
    """Length, count and per-dimension sums of the vectors of the commonest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, flat = _integers(batch.column(0), grid)
            of = np.repeat(lengths, lengths)
            for length in np.unique(lengths).tolist():
                x = flat[of == length].reshape(-1, length)
                safe = len(x) * max(abs(int(x.min())), abs(int(x.max()))) < _LONG
                sums = (x if safe else x.astype(object)).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(length, length), pa.int32()), pa.array(np.arange(length), pa.int32()),
                        pa.array(np.full(length, len(x)), pa.int64()), pa.array([str(s) for s in sums], pa.string()),
                    ],
                    ["dim", "i", "n", "s"],
                )

    parts = docs.mapInArrow(run, "dim int, i int, n long, s string")
    by_entry = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    top = by_entry.filter("i = 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).select(F.col("dim").alias("top"))
    rows = sorted(by_entry.join(F.broadcast(top), F.col("dim") == F.col("top")).select("i", "n", "s").collect())
    return (len(rows), rows[0].n, [int(r.s) for r in rows]) if rows else (0, 0, [])


def _gram(docs: DataFrame, dim: int, vectors) -> np.ndarray:
    """Sum over all rows of v v', for the vectors (rows x dim) that ``vectors`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = vectors(batch)
            total += v.T @ v
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    found = docs.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dim, dim))
    i, j, v = (found.column(c).to_numpy() for c in "ijv")
    out[i, j] = out[j, i] = v
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, l) with a[order][:, order] = l l'; l has a column for each pivot worth it."""
    dim = len(a)
    order, l = np.arange(dim), np.zeros((dim, dim))
    left = a.diagonal().astype(float).copy()
    first = left.max(initial=0.0)
    for k in range(dim):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > RANK * first:
            return order, l[:, :k]
        order[[k, p]], left[[k, p]], l[[k, p]] = order[[p, k]], left[[p, k]], l[[p, k]]
        l[k, k] = np.sqrt(left[k])
        rest = order[k + 1 :]
        l[k + 1 :, k] = (a[rest, order[k]] - l[k + 1 :, :k] @ l[k, :k]) / l[k, k]
        left[k + 1 :] -= l[k + 1 :, k] ** 2
    return order, l


def _rounds(m: int) -> list[np.ndarray]:
    """All pairs of m columns, as rounds of disjoint pairs (a round-robin schedule)."""
    seats = list(range(m + m % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[: len(seats) // 2], reversed(seats)) if max(a, b) < m]
        out.append(np.array(pairs, np.int64).reshape(-1, 2))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(l: np.ndarray) -> np.ndarray:
    """``l`` with its columns rotated until they are orthogonal to working precision."""
    l = l.copy()
    rounds = _rounds(l.shape[1]) if l.shape[1] > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for pairs in rounds:
            x, y = l[:, pairs[:, 0]], l[:, pairs[:, 1]]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            half = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(half < 0, -1.0, 1.0) / (np.abs(half) + np.hypot(1, half)), 0.0)
            c = 1 / np.hypot(1, t)
            l[:, pairs[:, 0]], l[:, pairs[:, 1]] = c * x - c * t * y, c * t * x + c * y
        if worst < 1e-14:
            break
    return l


def fit(docs: DataFrame, vec_col: str = "embedding", components: int = 32, grid: Grid = Grid()) -> Whitener:
    """Components of all usable vectors of ``docs``, at most ``components`` of them.

    A vector is usable if it is not null or empty, all its entries are finite
    numbers whose integers fit a long, and it has the commonest length of such
    vectors (the longer one of a tie). Repeated rows count as often as they
    occur. Directions without spread have no component, so a table without
    usable vectors, or with equal ones only, has none.
    """
    vectors = bound_batches(docs).select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    dim, n, sums = _count(vectors, grid)
    if not dim:
        return Whitener(grid, 0, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        x = _integers(batch.column(0), grid, dim)[2].reshape(-1, dim)
        return (_scaled(x, n, sums) / n).astype(np.float64)

    scatter = _gram(vectors, dim, centred)
    order, l = pivoted_cholesky(scatter)
    l = one_sided_jacobi(l)
    squares = (l * l).sum(axis=0)
    best = np.argsort(-squares, kind="stable")[:components]
    found = np.zeros((len(best), dim))
    found[:, order] = (l[:, best] / np.sqrt(squares[best])).T
    # Either sign is right; the largest entry is made positive.
    peak = np.abs(found).argmax(axis=1) if len(best) else np.zeros(0, np.int64)
    found *= np.where(found[np.arange(len(best)), peak] < 0, -1.0, 1.0)[:, None]
    return Whitener(grid, dim, n, sums, found, squares[best] / n, float(scatter.trace() / n))


def _project(x: np.ndarray, model: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, and the whitened vectors."""
    scaled = _scaled(x, model.n, model.sums)
    centred = (scaled / model.n).astype(np.float64)
    return scaled, centred @ model.components.T / np.sqrt(model.eigenvalues)


def identity_error(docs: DataFrame, model: Whitener, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def with_one(batch: pa.RecordBatch) -> np.ndarray:
        x = _integers(batch.column(0), model.grid, model.dim)[2].reshape(-1, model.dim)
        w = _project(x, model)[1]
        return np.hstack([w, np.ones((len(w), 1))])

    total = _gram(bound_batches(docs).select(F.col(f"`{vec_col}`").cast("array<double>").alias("v")), k + 1, with_one) / model.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def whiten(docs: DataFrame, model: Whitener, vec_col: str = "embedding", out_col: str = "whitening", keep_vector: bool = True) -> DataFrame:
    """The rows with usable vectors of the model's length, with a struct ``out_col``.

    ``whitened`` holds a number for each component; ``deviation`` is the sum
    over dimensions of (n * x - sum of x) squared, exactly, or null where that
    doesn't fit a long. Other rows go. A column of ``docs`` called ``out_col``
    (in any case) is replaced.
    """
    names = [c for c in docs.columns if c.lower() != out_col.lower() and (keep_vector or c != vec_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, flat = _integers(batch.column(len(names)), model.grid, model.dim)
            scaled, white = _project(flat.reshape(-1, model.dim), model)
            k = white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(white.ravel()))
            out = pa.StructArray.from_arrays([lists, pa.array(_deviations(scaled), pa.int64())], ["whitened", "deviation"])
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(names))] + [out], [*names, out_col])

    kind = T.StructType.fromDDL("whitened array<double>, deviation long")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out_col, kind)])
    if not model.dim:
        return docs.sparkSession.createDataFrame([], schema)
    vector = F.col(f"`{vec_col}`").cast("array<double>").alias(free_name(docs.columns, "vector"))
    return bound_batches(docs).select(*[F.col(f"`{c}`") for c in names], vector).mapInArrow(run, schema)
