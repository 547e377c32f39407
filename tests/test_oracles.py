"""Every query with an oracle against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from docketloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
