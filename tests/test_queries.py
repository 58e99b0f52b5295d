"""Every registered query of the library's own operators against DuckDB over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tablebridge.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got
        return
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert got == sorted(repr([norm(v) for v in r]) for r in want)
