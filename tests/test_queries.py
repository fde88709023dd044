"""Each query of the catalogue against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from stonefly.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want and sorted(names) == sorted(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
