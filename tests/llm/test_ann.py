import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonefly.llm import ann

def asked():
    return F.col("vec_id") % 20 == 0


def brute(rows, k=20):
    """rows: (id, vector) that take part. Lists of (id, score), nearest first, ties to the smaller id."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = {(-math.fsum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q}
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, label string, score int").repartition(3)


def noise(n, d=8, seed=1):
    r = np.random.default_rng(seed)
    return [(i, r.normal(size=d).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 50)
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = noise(400)
    assert lists(ann.nearest(frame(spark, rows, kind), asked(), exact=True)) == brute(rows)


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows), lists(ann.nearest(df, asked()))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_recall_beyond_sample(spark, monkeypatch):
    """With a sample of a tenth of the rows, clustered vectors of unequal lengths."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 400)
    monkeypatch.setattr(ann, "BUCKET", 300)
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 16))
    rows = [(i, ((centres[i % 30] + 0.3 * r.normal(size=16)) * r.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(4000)]
    want, got = brute(rows), lists(ann.nearest(frame(spark, rows), asked()))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_walk_order():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 10))
    ix = ann.Index(np.arange(600), x, 4000, 20)
    a, b = ix.sums(x[:1])
    cells = list(ix.walk(a[0], b[0], -np.inf))
    sums = [a[0][c // len(ix.b)] + b[0][c % len(ix.b)] for c in cells]
    assert sorted(cells) == list(range(len(ix.a) * len(ix.b))) and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:], strict=False))
    part = list(ix.walk(a[0], b[0], 0.5))
    assert sorted(part) == sorted(c for c, s in zip(cells, sums, strict=True) if s >= 0.5)


def test_copies(spark, monkeypatch):
    """A third of all rows are one vector: the bucket is split, ties go to the smaller ids."""
    monkeypatch.setattr(ann, "BUCKET", 64)
    rows = [(i, [1.0, 2.0, 0.5, -1.0] if i % 3 == 0 else v) for i, v in noise(600, 4)]
    want = brute(rows)
    assert lists(ann.nearest(frame(spark, rows), asked(), exact=True)) == want
    got = lists(ann.nearest(frame(spark, rows), asked()))
    assert all(got[q] == want[q] for q in want if q % 3 == 0)


def test_repeated_rows(spark):
    """Rows that are there thirty times count once, also for the score that ends the search."""
    rows = noise(60, 4)
    assert lists(ann.nearest(frame(spark, rows + [rows[3], rows[7]] * 30 + [rows[20]] * 5), asked())) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0]), (20, [1.0, 2.0]), (40, [0.5, 0.0])]
    bad = [(60, None), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [1.0]), (160, []), (None, [1.0, 1.0])]
    df = frame(spark, [*good, *bad, (180, [None, 1.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0])])
    got = lists(ann.nearest(df, asked()))
    assert got == brute(good)
    assert got[0][0] == (20, 5.0) and len(got[0]) == 4
    for empty in (df.limit(0), frame(spark, [(60, None), (80, [0.0, 0.0])]), frame(spark, [(1, [1.0]), (2, [2.0])])):
        assert ann.nearest(empty, asked()).collect() == []
    assert ann.nearest(frame(spark, [(20, [1.0])]), asked()).collect() == []
    # one id, two vectors: candidates both, one list
    two = lists(ann.nearest(frame(spark, [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 4.0]), (1, [1.0, 1.0])]), asked()))
    assert two[20][0] == (1, 4.0)
