"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, (bool, str)) or not isinstance(v, (int, float)):
        return (2, str(v))
    return (1, f"{float(v):.7g}")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted([cell(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted([cell(r[i]) for i in at] for r in found.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 30
