"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from capturelake.plans import catalogue, collector, dumps, findings, handshakes, searches  # noqa: F401


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, map(tuple, got.collect())) == table(columns, want.fetchall())
