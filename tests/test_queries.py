"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from needmatch.sources.tables import BASE_TABLES
from tools.check import table

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "similarity" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    assert table(df.columns, rows) == table([c[0] for c in cur.description], cur.fetchall())
