"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import whitening
from threadlens.llm.queries import op11_whiten


def _brute(vectors, most=32):
    x = np.floor(64.0 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - s]
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = _brute([r.embedding for r in rows])
    found = op11_whiten(spark, sf_dir).orderBy("vec_id", "component").toPandas()
    assert len(found) == len(rows) * 32 and found["n"].eq(n).all()
    assert found["component"].tolist() == list(range(1, 33)) * len(rows)
    assert found["deviation"].tolist() == np.repeat(deviation, 32).tolist()
    np.testing.assert_allclose(found["explained"].to_numpy().reshape(-1, 32)[0], explained, rtol=1e-9)
    got = found["whitened"].to_numpy().reshape(-1, 32)
    sign = np.sign((got * white).sum(axis=0))
    np.testing.assert_allclose(got * sign, white, atol=1e-6)
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9


def test_cholesky_and_jacobi_on_a_graded_matrix():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    e = np.logspace(0, -7, 24)
    order, l = whitening.pivoted_cholesky(q * e @ q.T)
    norms = np.sort((whitening.one_sided_jacobi(l) ** 2).sum(axis=0))[::-1]
    np.testing.assert_allclose(norms, e, rtol=1e-7)
    np.testing.assert_allclose(l @ l.T, (q * e @ q.T)[np.ix_(order, order)], atol=1e-14)
    assert np.allclose(np.triu(l, 1), 0)


EDGES = [
    (1, [1.0, 2.0, 3.0], "a"),
    (1, [1.0, 2.0, 3.0], "a"),
    (None, [0.5, -2.0, 3.0], None),
    (2, None, "b"),
    (3, [1.0, None, 3.0], "b"),
    (4, [1.0, math.nan, 3.0], "b"),
    (5, [1.0, math.inf, 3.0], "b"),
    (6, [1.0], "b"),
    (7, [], "b"),
    (8, [-4.0, 0.25, 3.0], "b"),
    (9, [2.0, 1e30, 3.0], "b"),
]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "vec_id long, embedding array<float>, Whitening string").withColumn("v", F.lit("x"))
    model = whitening.fit(df)
    assert (model.n, model.dim) == (4, 3) and len(model.eigenvalues) == 2  # the third dimension has no spread
    got = whitening.whiten(df, model).select("vec_id", "v", "whitening.*").collect()
    n, deviation, white, _ = _brute([e[1] for e in EDGES if e[0] in (1, None, 8)], 2)
    assert sorted(map(str, [r.vec_id for r in got])) == ["1", "1", "8", "None"] and {r.v for r in got} == {"x"}
    assert sorted(r.deviation for r in got) == sorted(deviation)
    np.testing.assert_allclose(sorted(abs(r.whitened[0]) for r in got), sorted(abs(white[:, 0])), rtol=1e-9)
    assert whitening.identity_error(df, model) < 1e-9




@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert len(model.eigenvalues) == 0 and whitening.identity_error(df, model) == 0.0
    usable = [r for r in rows if r[1]]
    assert [r.whitening.deviation for r in whitening.whiten(df, model).collect()] == [0] * len(usable)


def test_long_sums_and_deviations(spark):
    """Integers whose products leave 64 bits are handled exactly; a deviation beyond a long is null."""
    df = spark.createDataFrame([(1, [2.0**50]), (2, [-(2.0**50)]), (3, [0.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert model.sums == [3_000_000]
    got = {r.vec_id: r.whitening for r in whitening.whiten(df, model).collect()}
    assert [got[i].deviation for i in (1, 2, 3)] == [None, None, 0]
    assert abs(got[1].whitened[0]) == pytest.approx(math.sqrt(1.5))


def test_hot_vector(spark):
    df = spark.range(3000).selectExpr("id vec_id", "if(id % 3 = 0, array(1D, 2D), array(sin(id), cos(id * id))) embedding")
    model = whitening.fit(df)
    assert model.n == 3000 and whitening.identity_error(df, model) < 1e-9
