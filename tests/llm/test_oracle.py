"""Queries with SQL against DuckDB, and the entry point's registration."""

import duckdb
import pytest

from threadlens.llm.oracle import ORACLE
from threadlens.llm.queries import QUERIES

TABLES = ("documents", "pages", "labels", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in found.select(*names).collect()) == expected


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    registered = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registered if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in registered
    assert set(ORACLE) <= set(entry.oracle_sql())
