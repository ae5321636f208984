"""The pipeline's stages, each against brute force on its own input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import _components, _sets
from tests.llm.test_models import contamination
from threadlens.llm import quality
from threadlens.llm.oracle import OP2
from threadlens.llm.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage, written and read like the runner does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        done = stage(function(spark, docs, SF), f"test-{name}")
        out.append((docs, done))
        docs = done
    return out


def test_columns(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert [done.dtypes for _, done in steps[:-1]] == [columns] * 4
    assert steps[-1][1].columns == ["doc_id", "piece_ids", "n_pieces", "lossless"]


def test_quality_stage(spark, steps):
    docs, done = steps[0]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = quality.score(docs.select("doc_id", "text"), model).filter("quality_check.kept").select("doc_id")
    assert sorted(r[0] for r in done.select("doc_id").collect()) == sorted(r[0] for r in expected.collect())
    assert 0.5 * docs.count() < done.count() < docs.count()


def test_lines_stage(steps):
    docs, done = steps[1]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    expected = con.execute(f"SELECT doc_id, text FROM ({OP2})").fetchall()
    assert sorted(map(tuple, done.select("doc_id", "text").collect())) == sorted(expected)
    assert done.filter("n_chars <> length(text)").count() == 0


def test_near_dups_stage(steps):
    docs, done = steps[2]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sets = _sets(rows)
    kept = [i for (i, _), c in zip(sets, _components(sets, 80)) if i == c]
    assert sorted(r[0] for r in done.select("doc_id").collect()) == sorted(kept)


def test_benchmark_stage(spark, steps):
    docs, done = steps[3]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [x[0] for x in contamination(rows, items) if not x[-1]]
    assert sorted(r[0] for r in done.select("doc_id").collect()) == sorted(kept)


def test_pieces_stage(steps):
    docs, done = steps[4]
    assert done.count() == done.filter("lossless").count() == docs.count()


def test_stages_take_edge_tables(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, function in corpus_pipeline.STAGES[:-1]:
            done = function(spark, docs, SF)
            assert done.columns == docs.columns and done.count() <= docs.count()
            # Extra columns come through as they are, whatever their names.
            extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
            assert all(r[c] == f"x-{c}" for r in done.select([F.col(f"`{c}`") for c in extra]).collect() for c in extra)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_dups_stage_keeps_one_row_of_a_group(spark):
    """Rows that repeat an id and text, an id with two near texts, and groups without an id."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(100))
    rows = [(8, ""), (8, ""), (None, None), (None, None), (1, words(1)), (1, words(1)), (2, words(1) + " more")]
    rows += [(None, words(2)), (None, words(2)), (None, words(2) + " more"), (None, words(3)), (None, words(4)), (7, words(4) + " more")]
    rows += [(5, words(5)), (5, words(5) + " more"), (9, words(6))]
    docs = spark.createDataFrame([(*r, {"row": str(i)}) for i, r in enumerate(rows)], "doc_id long, text string, other map<string, string>").coalesce(1)
    got = [(r["doc_id"], (r["text"] or "").split("x")[0]) for r in corpus_pipeline.near_dups_stage(spark, docs, SF).collect()]
    expected = [(1, "w1"), (None, "w2"), (None, "w3"), (7, "w4"), (5, "w5"), (8, ""), (8, ""), (None, ""), (None, ""), (9, "w6")]
    assert sorted(map(str, got)) == sorted(map(str, expected))
