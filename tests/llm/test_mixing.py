import duckdb
import pytest

from stonefly.llm import mixing

COLUMNS = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]


def oracle(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(map(tuple, con.sql(mixing.SQL).select(*COLUMNS).fetchall()), key=repr)


def mine(docs):
    return sorted(map(tuple, mixing.mix(docs).select(*COLUMNS).collect()), key=repr)


def water(sizes):
    """Targets by repeated resharing: sources in order of code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_table(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    got = mine(docs)
    assert [(r[0], r[1], r[2], r[3], pytest.approx(r[4]), r[5], r[6]) for r in oracle(docs)] == got
    assert got == mine(docs.repartition(7))
    sizes, taken, most = {}, {}, {}
    for r in got:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
        taken[r[1]] = taken.get(r[1], 0) + r[6]
        most[r[1]] = max(most.get(r[1], 0), r[2])
        assert r[6] <= 2 * r[2]
    for s, t in water(sizes).items():
        assert next(r[4] for r in got if r[1] == s) == pytest.approx(t)
        assert abs(taken[s] - t) <= most[s]


def test_buckets(spark, monkeypatch):
    """Cutting a source into many buckets changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = mine(docs)
    monkeypatch.setattr(mixing, "BUCKET", 3)
    monkeypatch.setattr(mixing, "PARTS", 8)
    assert mine(docs) == whole


def test_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert mixing.mix(docs).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def test_the_interval_of_the_budget_is_small(spark):
    """However the weights are: a source of weight 0.1 throughout, whose keys are large and spread, among others."""
    from pyspark.sql import functions as F

    from stonefly.llm.common import Scratch

    n = 120_000
    u = (F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = spark.range(n).select((F.col("id") % 3).alias("sid"), F.lit(3_000_000.0).alias("rest"), (-F.log(u) / F.element_at(F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0)), (F.col("id") % 3 + 1).cast("int"))).alias("key"), F.lit(100).cast("bigint").alias("size"))
    scratch = Scratch(spark)
    own = scratch.cut(rows)
    edges = mixing._edges(own, scratch)
    held = {r.sid: (r.n, r.before, r.under) for r in own.join(edges, "sid").groupBy("sid", "before").agg(F.count_if(F.col("key").between(F.col("least"), F.col("most"))).alias("n"), F.sum(F.when(F.col("key") < F.col("least"), F.col("size"))).alias("under")).collect()}
    assert len(held) == 3
    for k, before, under in held.values():
        assert 0 < k <= mixing.BUCKET and before == under and before < 3_000_000 <= before + 100 * k


def test_edges(spark):
    rows = [(1, "a", "x y z", 1), (2, "a", None, 2), (3, "a", "", 3), (4, None, "one two", 4), (None, None, "three four five six", 5), (5, "b", "w " * 3000, 6), (6, "c", None, 7), (7, "b", "v", 8), (7, "b", "v", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert {(r.source, r.source_size) for r in got} == {("a", 3), (None, 6), ("b", 3002), ("c", 0)}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert len({r.taken for r in got if r.doc_id == 7}) == 1
    assert mixing.mix(docs.limit(0)).collect() == []
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    counts = {}
    for r in taken.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    want = {}
    for r in got:
        text = next(t for i, s, t, _ in rows if (i, s) == (r.doc_id, r.source))
        want[r.doc_id, text] = want.get((r.doc_id, text), 0) + r.copies
    assert counts == {k: v for k, v in want.items() if v}


def test_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_heavier_first(spark):
    """Documents of more weight are likelier to be taken."""
    rows = [(i, "z", ("word " if i % 2 else "w### ") * 10) for i in range(4000)] + [(10_000 + i, f"t{i % 2}", "word " * 10) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).filter("source = 'z'").collect()}
    good, bad = sum(v for k, v in copies.items() if k % 2), sum(v for k, v in copies.items() if not k % 2)
    assert good > 1.2 * bad > 0
