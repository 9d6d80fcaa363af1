"""Every query with an SQL counterpart gives DuckDB's rows on the smallest tables."""

import os

import pytest

from lectern.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, duck, tmp_path, name):
    QUERIES[name](spark, FOLDER).write.parquet(f"{tmp_path}/out")
    columns = ", ".join(sorted(duck.sql(ORACLES[name]).columns))
    wanted = sorted(map(repr, duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()))
    got = sorted(map(repr, duck.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'").fetchall()))
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
