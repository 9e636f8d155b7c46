"""The queries against their SQL on the driver's tables."""

import duckdb
import pytest

from brindle.llm import queries

TABLES = ("documents", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    names = sorted(expected.columns)
    assert sorted(got.columns) == names
    rows = sorted(map(str, got.select(*names).toPandas().itertuples(index=False, name=None)))
    assert rows == sorted(map(str, expected.df()[names].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_a_document(spark, sf_dir, name):
    table, key = ("embeddings", "vec_id") if "embedding" in name else ("documents", "doc_id")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.select(key).distinct().count() == n
    assert name == "op8_packing" or out.count() == n
