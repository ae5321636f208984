"""The signature-tree join against brute force."""

import random

import numpy as np
import pytest

from tests.llm.conftest import EDGE_ROWS
from tests.llm.test_dedup import _components, _sets, near_rows
from threadlens.llm import components, signature_join as join


def _check(spark, df, rows, percent=80):
    sets = _sets(rows)
    expected = [(i, len(s), c) for (i, s), c in zip(sets, _components(sets, percent))]
    assert sorted(map(repr, map(tuple, join.signature_join(df, percent=percent).collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("percent", [80, 85, 60])
def test_matches_brute_force(spark, percent):
    rows = near_rows(percent)
    _check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, percent)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _check(spark, docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def _template_rows(seed, n, edits):
    """Two templates with many variants each, whose similarities lie about the least one."""
    rng = random.Random(seed)
    rows = []
    for t in range(2):
        base = [f"t{t}w{i}" for i in range(120)]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.choice(edits)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(f"own{i}x{k}" for k in range(50))) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 6])
def test_templates_in_a_third_of_all_rows_each(spark, monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK", block)
    rows = _template_rows(7, 60, [0, 1, 2, 3, 4, 5])
    _check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("block", [512, 6])
def test_passage_in_a_third_of_all_rows(spark, monkeypatch, block):
    """A shared passage links nothing; with and without the table of frequent shingles."""
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "LEAST_FREQUENT", 16 if block > 6 else 10**6)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        own = [f"o{i}x{k}" for k in range(rng.choice([20, 80, 100]))]
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:] if i % 3 == 0 else own)))
    rows += [(1000 + i, t + " more") for i, t in rows[:9]]
    _check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_components_are_searched_once_unless_links_come(spark, monkeypatch):
    """Near copies that all meet in the first buckets: later rounds find no link and don't search components again."""
    searched, search = [], components.connected_components
    for module in (components, join):
        monkeypatch.setattr(module, "connected_components", lambda *a: searched.append(a) or search(*a))
    base = [[f"t{t}w{i}" for i in range(100)] for t in range(12)]
    rows = [(3 * t + k, " ".join(words[: 100 - k])) for t, words in enumerate(base) for k in range(3)]
    _check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert len(searched) == 1


def test_edges(spark, edge_docs, no_docs):
    _check(spark, edge_docs.selectExpr("*", "1 key", "2 class", "'x' t1"), [(i, t) for i, t, *_ in EDGE_ROWS])
    assert join.signature_join(no_docs).collect() == []
    with pytest.raises(ValueError):
        join.signature_join(no_docs, percent=50)


def test_prefixes_meet():
    """Sets at or above the similarity share one of their first shingles, whatever is frequent."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        common = rng.integers(0, 1 << 62, rng.integers(8, 60), dtype=np.uint64)
        more = rng.integers(0, 1 << 62, 2 * (len(common) // 8), dtype=np.uint64)
        a, b = np.unique(np.concatenate([common, more[::2]])), np.unique(np.concatenate([common, more[1::2]]))
        if not join._linked(80, a, b):
            continue
        frequent = np.sort(rng.choice(common, len(common) // 2, replace=False))
        table = frequent, rng.permutation(len(frequent)) + 1
        x, y = join.prefixes([a, b], 80, table)
        assert len(np.intersect1d(x, y)) > 0


def test_bounds_hold():
    """No pair of linked sets is left out by the bitmaps, at equal or at neighbouring widths."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 62, n // 12, dtype=np.uint64)]))
        met = []
        sizes = np.array([len(a), len(b)])
        walk = join.Traversal(80, sizes, np.arange(2), np.zeros(2, int), np.zeros((2, 0), np.float32), lambda i, j: met.append((i, j)))
        walk.run(np.arange(2), [join.signature(a).tobytes(), join.signature(b).tobytes()])
        assert met or not join._linked(80, a, b)


def test_frequent_shingles(spark):
    docs = spark.range(300).selectExpr("id doc_id", "concat(if(id % 2 = 0, 'a b c d e f ', ''), 'own', id, ' x', id, ' y z', id) text")
    keys, ranks = join.frequent_shingles(join._texts(docs, "doc_id", "text"))
    assert len(keys) == 2 and sorted(ranks) == [1, 2]
