"""Every query of the editorial model against its SQL, and the contract of the entry module."""

import glob
import math
import os

import pytest

import __spark_entry__ as contract
from quoin.plans import QUERIES, SQL


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return [plain(x) for x in value]
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, (int, bool, type(None))):
        return value
    return float(f"{float(value):.9g}") if type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [[plain(row[c]) for c in columns] for row in frame.collect()]
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [[plain(row[names.index(c)]) for c in columns] for row in result.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert got or name == "c04_same_file"  # no two of ten jobs share a file


def test_contract(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert contract.entry(spark).count() > 0


def test_every_editorial_query_has_sql():
    assert set(QUERIES) == set(SQL)
