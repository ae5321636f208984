"""Clustering, agreement, recurrence, and thread order with missing positions."""

import datetime
import math
import random

import numpy as np
import pytest

from threadlens.operators import agreement, clustering, recurrence
from threadlens.operators import threads as TH


def test_missing_positions_come_last(spark):
    rows = [("r", 1, 13, None, "d"), ("r", 1, 12, None, "c"), ("r", 1, 99, 1, "a"), ("r", 1, 11, 2, "b"), ("r", 1, None, None, "e")]
    df = spark.createDataFrame(rows, "repository string, issue_number long, comment_id long, position_in_thread int, comment_body string")
    for c in (df, df.drop("position_in_thread")):
        got = TH.comment_threads(c).first()["comments_text"].split(TH.COMMENT_SEPARATOR)
        assert got == (list("abcde") if "position_in_thread" in c.columns else list("bcdae"))


# --- clustering ---------------------------------------------------------------------

def test_clusters_are_nearest_and_centres_are_means(spark):
    rng = np.random.default_rng(1)
    middles = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]], float)
    x = np.concatenate([m + rng.normal(scale=0.4, size=(60, 3)) for m in middles])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    vectors = clustering.usable_vectors(df, "id", "v")
    centres = clustering.cluster(vectors, k=4, rounds=20)
    got = {r["id"]: r["cluster"] for r in clustering.assign(vectors, centres).collect()}
    distance = np.linalg.norm(x[:, None] - centres.points[None], axis=2)
    assert [got[i] for i in range(len(x))] == [centres.ids[j] for j in distance.argmin(axis=1)]
    for j, c in enumerate(centres.ids):
        np.testing.assert_allclose(centres.points[j], x[[i for i in got if got[i] == c]].mean(axis=0))
    assert all(len({got[i] for i in range(a, a + 60)}) == 1 for a in range(0, 240, 60)) and len(set(got.values())) == 4


def test_clusters_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))], "id long, v array<double>")
    a, b = (sorted(map(tuple, clustering.clusters(d, "id", "v", k=5).select("id", "cluster").collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert a == b and len({c for _, c in a}) == 5


def test_cluster_edges(spark):
    schema = "id long, v array<float>"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0]), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [1.0]), (7, []), (8, [4.0, 2.0])]
    got = clustering.clusters(spark.createDataFrame(rows, schema), "id", "v", k=3).collect()
    assert sorted((r["id"], r["cluster"], r["distance"]) for r in got) == [(1, 1, 0.0), (1, 1, 0.0), (8, 8, 0.0)]
    assert clustering.clusters(spark.createDataFrame([], schema), "id", "v").collect() == []
    same = spark.createDataFrame([(i, [3.0, 3.0]) for i in range(50)], schema)
    assert {r["cluster"] for r in clustering.clusters(same, "id", "v").collect()} and clustering.cluster_summary(clustering.clusters(same, "id", "v")).first()["members"] == 50


# --- agreement ----------------------------------------------------------------------

def _agreement(spark, first, second):
    schema = "annotation_id string, primary_label string"
    pairs = agreement.label_pairs(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema))
    return {r["label"]: r for r in agreement.agreement(pairs).collect()}


def test_agreement_against_counts(spark):
    rng = random.Random(4)
    labels = ["a", "b", "c"]
    first = [(f"i{i}", rng.choice(labels)) for i in range(200)]
    second = [(i, lab if rng.random() < 0.7 else rng.choice(labels)) for i, lab in first]
    got = _agreement(spark, first, second)
    n, pairs = 200, list(zip([x[1] for x in first], [x[1] for x in second]))
    for lab in labels:
        a, b = [x == lab for x, _ in pairs], [y == lab for _, y in pairs]
        observed = sum(p == q for p, q in zip(a, b)) / n
        expected = (sum(a) * sum(b) + (n - sum(a)) * (n - sum(b))) / n**2
        assert got[lab]["kappa"] == pytest.approx((observed - expected) / (1 - expected))
    observed = sum(x == y for x, y in pairs) / n
    expected = sum(sum(x == lab for x, _ in pairs) * sum(y == lab for _, y in pairs) for lab in labels) / n**2
    assert got[agreement.OVERALL]["kappa"] == pytest.approx((observed - expected) / (1 - expected))


def test_agreement_edges(spark):
    first = [("x", " A "), ("y", "b"), ("z", ""), ("w", None), (None, "a"), ("only", "a")]
    second = [("x", "a"), ("y", None), ("z", "b"), ("late", "c")]
    got = _agreement(spark, first, second)
    assert {k: (r["n_both"], r["agreed"], r["one_sided"]) for k, r in got.items()} == {
        "a": (1, 1, 1), "b": (1, 1, 2), "c": (1, 1, 1), agreement.OVERALL: (1, 1, 4),
    }
    assert got["a"]["kappa"] is None  # one label alone: chance agrees always
    assert _agreement(spark, [], []) == {}


# --- recurrence ---------------------------------------------------------------------

def _threads(spark, rows):
    return spark.createDataFrame(rows, "cues array<string>, created_on date, state string")


def test_runs_and_spells(spark):
    day = lambda w, d=0: datetime.date(2024, 1, 1) + datetime.timedelta(weeks=w, days=d)
    rows = [(["a", "b", "a"], day(0), "closed"), (["a"], day(1, 6), "open"), (["a"], day(1), "closed"), (["a"], day(5), "closed"), (["b"], day(9), "open")]
    rows += [([], day(3), "open"), (None, day(3), "open"), (["c"], None, "open"), ([None], day(3), "open")]
    weekly = recurrence.weekly_cues(_threads(spark, rows))
    got = {r["cue"]: r for r in recurrence.recurrence(weekly).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"}
    assert (a["n_threads"], a["n_weeks"], a["n_runs"], a["longest_run"], a["longest_gap"], a["n_open"], a["open_spell_weeks"], a["persists"]) == (4, 3, 2, 2, 3, 1, 9, False)
    assert (b["n_runs"], b["longest_gap"], b["open_spell_weeks"], b["persists"], b["first_week"]) == (2, 8, 1, True, "2024-01-01")
    assert recurrence.recurrence(recurrence.weekly_cues(_threads(spark, []))).collect() == []


def test_hot_cue_is_counted_before_windows(spark):
    """A cue in most rows reaches the windows as one row a week."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, array('rare', 'hot'), array('hot')) cues", "date_add(date '2024-01-01', cast(id % 70 as int)) created_on", "'open' state")
    weekly = recurrence.weekly_cues(df)
    assert weekly.count() == 20
    assert {r["cue"]: (r["n_threads"], r["n_runs"], r["longest_run"]) for r in recurrence.recurrence(weekly).collect()} == {"hot": (6000, 1, 10), "rare": (2000, 1, 10)}
