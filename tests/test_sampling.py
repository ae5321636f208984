import pytest
from pyspark.sql import functions as F

from threadlens.operators import sampling as SM


def threads(spark, n_signal, n_plain):
    rows = [("r", i, 1 if i < n_signal else 0) for i in range(n_signal + n_plain)]
    return spark.createDataFrame(rows, "repository string, issue_number long, heuristic_score int")


def test_mix_and_determinism(spark):
    t = threads(spark, 50, 150)
    a = SM.stratified_sample(t, 60)
    rows = a.collect()
    assert len(rows) == 60
    assert sum(1 for r in rows if r["heuristic_score"] > 0) == 42  # round(0.7 * 60)
    b = SM.stratified_sample(t, 60).collect()
    assert sorted(r["issue_number"] for r in rows) == sorted(r["issue_number"] for r in b)


def test_pool_shortfalls(spark):
    only_plain = SM.stratified_sample(threads(spark, 0, 30), 10).collect()
    assert len(only_plain) == 10
    only_signal = SM.stratified_sample(threads(spark, 30, 0), 10).collect()
    assert len(only_signal) == 10 and all(r["heuristic_score"] > 0 for r in only_signal)
    few_signals = SM.stratified_sample(threads(spark, 3, 30), 10).collect()
    assert sum(1 for r in few_signals if r["heuristic_score"] > 0) == 3
    bigger = SM.stratified_sample(threads(spark, 4, 4), 100).collect()
    assert len(bigger) == 8


def test_half_even_target(spark):
    # round(0.7 * 5) == 4 and round(0.7 * 15) == 10 (Python rounding)
    assert sum(1 for r in SM.stratified_sample(threads(spark, 20, 20), 5).collect() if r["heuristic_score"] > 0) == 4
    assert sum(1 for r in SM.stratified_sample(threads(spark, 20, 20), 15).collect() if r["heuristic_score"] > 0) == 10


def test_size_zero_is_an_error(spark):
    with pytest.raises(ValueError):
        SM.stratified_sample(threads(spark, 1, 1), 0)


def test_annotation_batch_ids(spark):
    t = threads(spark, 5, 5).withColumns({"issue_url": F.lit("u"), "title": F.lit("t"), "thread_text": F.lit("x"), "comments_count": F.lit(1), "matched_patterns": F.lit("")})
    b = SM.annotation_batch(t, 8).collect()
    assert sorted(r["annotation_id"] for r in b) == [f"NS-{i:04d}" for i in range(1, 9)]
    assert all(r["primary_label"] == "" for r in b)


def test_sequence_number_dense_per_group(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 3).cast("int")).withColumn("k", F.md5(F.col("id").cast("string")))
    s = SM.sequence_number(df.repartition(7), ["k"], ["g"], out="seq")
    stats = s.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("m")).collect()
    for r in stats:
        assert r["n"] == r["d"] == r["m"]


def test_folds_are_stratified(spark):
    rows = [(f"id{i}", 1 if i % 4 == 0 else 0) for i in range(103)]
    df = spark.createDataFrame(rows, "annotation_id string, target int")
    f = SM.stratified_folds(df, "target", 5).groupBy("fold", "target").count().collect()
    for t in (0, 1):
        sizes = [r["count"] for r in f if r["target"] == t]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_large_top_k_path(spark):
    df = spark.range(0, 3000).withColumn("k", F.md5(F.col("id").cast("string")))
    old = SM.TAKE_ORDERED_MAX
    SM.TAKE_ORDERED_MAX = 10
    try:
        big = SM.top_k(df, ["k"], 1234)
    finally:
        SM.TAKE_ORDERED_MAX = old
    small = df.orderBy("k").limit(1234)
    assert big.count() == 1234 and big.join(small, "id", "left_anti").count() == 0
