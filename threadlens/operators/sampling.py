"""Deterministic ordering, stratified sampling, folds and ids.

Random draws are replaced by a hash order: ``md5(key ':' seed)``. It is
reproducible across runs, engines and cluster sizes, and needs no global
state. Ranks are computed without single-partition windows: a range
partitioned sort plus per-partition offsets (``sequence_number``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.scoring import ANNOTATION_ID_PREFIX, annotation_id
from threadlens.session import cut_lineage
from threadlens.sources.schemas import ANNOTATION_COLUMNS, LABEL_COLUMNS, existing

DEFAULT_SEED = 42
SIGNAL_SHARE = 0.7
# Above this many rows a top-k no longer runs as one in-memory TakeOrdered task.
TAKE_ORDERED_MAX = 100_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def hash_order(keys: Sequence[str | Column], seed: int = DEFAULT_SEED, salt: str | None = None) -> Column:
    """``md5`` of the ``:``-joined key parts and seed — the sampling order."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    parts.append(F.lit(str(seed)))
    if salt:
        parts.append(F.lit(salt))
    return F.md5(F.concat_ws(":", *parts))


def sequence_number(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    out: str = "seq",
) -> DataFrame:
    """1-based row number per ``group`` in ``order`` without a one-task window.

    Rows are range-partitioned and sorted by ``group + order`` (which must be a
    total order; entries may carry a sort direction), a local index comes from
    ``monotonically_increasing_id``, and
    each (partition, group) gets its offset from a count table (one row per
    partition and group). The table is joined by key, so Spark broadcasts it
    only if it is small; with many groups it is as long as the group list.
    Pass narrow rows: they are checkpointed once.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    mask = (1 << _LOCAL_BITS) - 1
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_loc", F.monotonically_increasing_id().bitwiseAND(F.lit(mask))
    )
    # Range bounds are sampled from the input, whose row order after a shuffle
    # is not fixed; checkpoint the numbered rows once so the count branch and
    # the join branch see the very same partitioning (also survives executor loss).
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid", *group).agg(F.count("*").alias("_n"), F.min("_loc").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid") if group else Window.orderBy("_pid")
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    if group:
        joined = ranged.join(offsets, ["_pid", *group])
    else:  # one row per partition
        joined = ranged.join(F.broadcast(offsets), ["_pid"])
    return joined.withColumn(out, (F.col("_off") + F.col("_loc") - F.col("_first") + 1).cast("long")).drop(
        "_pid", "_loc", "_off", "_first"
    )


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """First ``k`` rows in ``order`` (a total order; entries may be sort columns).

    Small k is a TakeOrderedAndProject (per-task top-k, then merge); large k
    ranks with ``sequence_number`` so no task holds k rows in memory.
    """
    if k <= 0:
        return df.limit(0)
    if k <= TAKE_ORDERED_MAX:
        return df.orderBy(*order).limit(k)
    ranked = sequence_number(df, order, out="_rank")
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def stratified_sample(
    threads: DataFrame,
    sample_size: int,
    key: Sequence[str] = ("repository", "issue_number"),
    score: str = "heuristic_score",
    seed: int = DEFAULT_SEED,
    signal_share: float = SIGNAL_SHARE,
) -> DataFrame:
    """Mix of likely signals (score > 0) and ordinary discussions.

    n = min(sample_size, rows); the signal target is ``round(share * n)``
    (Python half-even) capped by the pool, the comparison pool fills the rest,
    and any shortfall is topped up from unused rows. Only one small count row
    reaches the driver. Output: key, score and ``_shuffle`` (final order key);
    ``fetch_threads`` brings the other columns.
    """
    if sample_size < 1:
        raise ValueError(f"a sample needs one row or more, not {sample_size}")
    key = list(key)
    order_key = hash_order(key, seed)
    # The pools, the count and the top-up read keys and scores alone: these narrow
    # rows are materialised once, the sampled keys then fetch their threads.
    scored = cut_lineage(threads.select(*key, score, order_key.alias("_sample_order")))
    counts = scored.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(score) > 0).alias("signals"),
        F.count_if(F.col(score) == 0).alias("ordinary"),
    ).first()
    n = min(sample_size, counts["total"])
    signal_target = min(counts["signals"], round(n * signal_share))
    comparison_target = min(counts["ordinary"], n - signal_target)
    withkey = scored
    parts = []
    if signal_target:
        parts.append(top_k(withkey.filter(F.col(score) > 0), ["_sample_order", *key], signal_target))
    if comparison_target:
        parts.append(top_k(withkey.filter(F.col(score) == 0), ["_sample_order", *key], comparison_target))
    selected = parts[0] if parts else withkey.limit(0)
    for p in parts[1:]:
        selected = selected.unionByName(p)
    remaining = n - signal_target - comparison_target
    if remaining > 0:
        unused = withkey.join(selected.select(*key), key, "left_anti")
        selected = selected.unionByName(top_k(unused, ["_sample_order", *key], remaining))
    return selected.withColumn("_shuffle", hash_order(key, seed, "shuffle")).drop("_sample_order")


def fetch_threads(sample: DataFrame, threads: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """The threads of sampled keys, with the sample's own columns beside theirs."""
    keep = [c for c in threads.columns if c in key or c not in sample.columns]
    held = F.broadcast(sample) if rows <= TAKE_ORDERED_MAX else sample
    return threads.select(*keep).join(held, list(key))


def number_sample(sample: DataFrame, key: Sequence[str], prefix: str = ANNOTATION_ID_PREFIX) -> DataFrame:
    """W2 + T18: ids ``NS-0001``... in the sample's shuffled order."""
    numbered = sequence_number(sample, ["_shuffle", *key], out="_seq")
    return numbered.withColumn("annotation_id", annotation_id("_seq", prefix)).drop("_seq", "_shuffle")


def annotation_batch(threads: DataFrame, sample_size: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """P1 tail: sample, number, add blank label columns (Q5), project (Q2)."""
    key = ["repository", "issue_number"]
    numbered = number_sample(stratified_sample(threads, sample_size, seed=seed), key)
    numbered = fetch_threads(numbered, threads, key, sample_size)
    numbered = numbered.withColumns({c: F.lit("") for c in LABEL_COLUMNS})
    return existing(numbered, ANNOTATION_COLUMNS)


def stratified_folds(
    df: DataFrame,
    target: str,
    k: int,
    key: str = "annotation_id",
    seed: int = DEFAULT_SEED,
    out: str = "fold",
) -> DataFrame:
    """Within each class, rows in hash order are dealt round-robin to k folds.

    Class sizes per fold differ by at most one, like a stratified k-fold. Only
    ``(key, target)`` is numbered; rows that repeat both share a fold.
    """
    keys = df.select(key, target).distinct().withColumn("_fold_order", hash_order([key], seed))
    ranked = sequence_number(keys, ["_fold_order", key], [target], "_r")
    folds = ranked.select(F.col(key).alias("_k"), F.col(target).alias("_t"), ((F.col("_r") - 1) % k).cast("int").alias(out))
    return df.join(folds, F.col(key).eqNullSafe(F.col("_k")) & F.col(target).eqNullSafe(F.col("_t"))).drop("_k", "_t")


def unlabelled_queue(annotations: DataFrame, limit: int | None = None, order: str = "annotation_id") -> DataFrame:
    """rows still waiting for a label, first ``limit`` in id order."""
    from threadlens.functions.text import is_blank

    q = annotations.filter(is_blank("primary_label"))
    if limit is not None:
        q = top_k(q, [order], limit)
    return q
