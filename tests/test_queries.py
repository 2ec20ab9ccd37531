"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import glob
import math
import os

import duckdb
import pytest

from corpuslens.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    made = QUERIES[name](spark, sf)
    columns = sorted(made.columns)
    told = duck.execute(SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=repr) == expected


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
