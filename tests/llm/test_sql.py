"""The queries that have SQL against it, on whole small tables."""

import math

import duckdb
import pytest

from stonefly.llm.queries import QUERIES, SQL


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name, d):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df, cur = QUERIES[name](spark, d), con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want
