"""Queries of the subpackage that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from cairn.llm import queries as llm

DIR = "/root/testdata/sf0.001"
SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = llm.queries()[name](spark, DIR)
    found = c.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())
