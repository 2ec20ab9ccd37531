"""Queries with SQL give the rows that DuckDB gives for it."""

import duckdb
import pytest

from corpuslens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    told = con.execute(queries.SQL[name])
    columns = [d[0] for d in told.description]
    made = queries.QUERIES[name](spark, sf)
    assert sorted(made.columns) == sorted(columns)
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(told.fetchall())
