"""Every core query with SQL against DuckDB on the driver's tables."""

import glob
import os

import duckdb
import pytest

from brindle.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*names).collect())
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == names
    want = sorted(repr(r) for r in duck.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({SQL[name]})").fetchall())
    assert rows == want
