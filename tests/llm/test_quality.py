import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonefly.llm import quality, textstats
from stonefly.llm.common import Scratch


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == out(i) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    rows = [(got[r.doc_id].score, r.quality, got[r.doc_id].predicted) for r in labels.collect() if out(r.doc_id)]
    ones, zeros = np.array([s for s, y, _ in rows if y]), np.array([s for s, y, _ in rows if not y])
    auc = ((ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2).item()
    assert auc > 0.97
    assert sum(p == y for _, y, p in rows) / len(rows) > 0.95
    assert abs(np.mean([s for s, _, _ in rows]) - np.mean([y for _, y, _ in rows])) < 0.05


def test_only_training_labels_count(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    was = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    now = {r.doc_id: r.score for r in quality.score(changed, other).collect()}
    assert was == pytest.approx(now, abs=1e-9)


def test_against_a_direct_solve(spark, tables):
    """Features written out term by term, and ridge weights by least squares on the stacked system."""
    docs, labels = tables
    y = {r.doc_id: int(r.quality >= 1) for r in labels.collect()}
    ids = [i for i in sorted(y) if not out(i)][:1500]
    v = np.array([textstats.vector(r.text.encode()) for r in docs.filter(F.col("doc_id").isin(ids)).orderBy("doc_id").collect()])
    target = np.array([y[i] for i in ids], float)
    calibrate = np.arange(len(ids)) % 4 == 0
    rows = spark.createDataFrame([(x.tolist(), int(t), bool(c)) for x, t, c in zip(v, target, calibrate, strict=True)], "v array<double>, y int, calibrate boolean").repartition(5)
    model = quality._fitted(rows)
    mean, scale = v.mean(0), np.sqrt(np.maximum(v.var(0), 1e-9))
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, rtol=1e-6)
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(size=(v.shape[1], quality.FEATURES)) * np.sqrt(2 * quality.GAMMA)
    b = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((v - mean) / scale, -6, 6)
    p = np.array([[1.0, *row, *[np.sqrt(2 / quality.FEATURES) * np.cos(row @ w[:, j] + b[j]) for j in range(quality.FEATURES)]] for row in z])
    a = np.vstack([p[~calibrate], np.sqrt(quality.RIDGE) * np.eye(p.shape[1])])
    want = np.linalg.lstsq(a, np.r_[target[~calibrate], np.zeros(p.shape[1])], rcond=None)[0]
    assert np.allclose(model.weights, want, atol=1e-6)
    assert np.allclose(model.raw(v), p @ want, atol=1e-6)
    # inner products of the cosines come near the Gaussian kernel
    c, d = p[:200, 1 + v.shape[1] :], ((z[:200, None] - z[None, :200]) ** 2).sum(2)
    assert np.abs(c @ c.T - np.exp(-quality.GAMMA * d)).mean() < 0.1
    # calibration: shares of ones in the bins of the rows that the fit did not see
    raw = p[calibrate] @ want
    at = np.clip((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(at)
    x, s = quality.isotonic(quality.LOW + (used + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS, np.array([target[calibrate][at == u].sum() for u in used]), np.array([(at == u).sum() for u in used]))
    assert np.allclose(model.x, x) and np.allclose(model.y, s)


def test_hot_ids(spark, tables):
    """Rows that share a labelled id train once, and the sample keeps to its bound."""
    docs, labels = tables
    one = docs.filter("doc_id < 600")
    hot = one.unionByName(reduce(lambda a, b: a.unionByName(b), [one.filter("doc_id = 7")] * 40))
    was = {r.doc_id: r.score for r in quality.score(one, labels).collect()}
    assert was == pytest.approx({r.doc_id: r.score for r in quality.score(hot, labels).collect()}, abs=1e-9)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "FIT_ROWS", 300)
        assert 200 < quality.training(labels, Scratch(spark)).count() < 400


def test_isotonic():
    """Against the definition: the value at i is max over a <= i of min over b >= i of the mean of a..b."""
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9, 40)
    ones = rng.binomial(total, np.linspace(0.1, 0.9, 40))
    x, y = quality.isotonic(np.arange(40.0), ones, total)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()
    mean = lambda a, b: ones[a : b + 1].sum() / total[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    sizes, at = [], 0
    for block in x:
        n = next(k for k in range(1, 41 - at) if abs(np.average(np.arange(at, at + k), weights=total[at : at + k]) - block) < 1e-9 and abs(mean(at, at + k - 1) - want[at]) < 1e-9 and (at + k == 40 or want[at + k] > want[at] + 1e-12))
        sizes.append(n)
        at += n
    assert at == 40


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some words here", "c"), (4, "w " * 100_000, "d"), (4, "w " * 100_000, "d"), (5, "\x00é|||", None)], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id bigint, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {None}
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    none = quality.score(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality.score(docs.limit(0), labels).collect() == []
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6


def test_statistics():
    for t in (None, b"", b" \n", b"x", "é日本 ##".encode(), b"a\n" * 1000, bytes(range(1, 128))):
        v = textstats.vector(t)
        assert len(v) == len(textstats.NAMES) and np.isfinite(v).all()
