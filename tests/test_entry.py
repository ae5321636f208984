import os

import duckdb
import pytest

import __spark_entry__ as E
from threadlens.plans.oracle import ORACLE

SMOKE = "/root/testdata/sf0.001"
NAMES = sorted(ORACLE)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["repository", "issue_number", "title", "comments_count", "heuristic_score", "matched_patterns", "thread_chars"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ["documents", "labels", "conversations", "events", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = E.queries()[name](spark, SMOKE)
    cols = df.columns
    spark_rows = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    duck_rows = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert spark_rows == duck_rows
