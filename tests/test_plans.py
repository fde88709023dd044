"""Plan shapes: join algorithms, pushed filters, pruning, top-k."""

import pytest
from pyspark.sql import functions as F

from stonefly.operators import joins as J
from stonefly.operators import relational as R

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sides(spark):
    return spark.range(50).select(F.col("id").alias("a")), spark.range(30).select(F.col("id").alias("b"))


@pytest.mark.parametrize("how", [J.JoinType.INNER, J.JoinType.LEFT, J.JoinType.RIGHT, J.JoinType.FULL])
def test_algorithms(spark, sides, how):
    a, b = sides
    assert "ShuffledHashJoin" in plan(J.hash_join(a, b, how, ["a"], ["b"]))
    assert "SortMergeJoin" in plan(J.merge_join(a, b, how, ["a"], ["b"]))
    nl = J.nested_loop_join(a, b, how, a.a < b.b)
    assert "NestedLoopJoin" in plan(nl) or "CartesianProduct" in plan(nl)


def test_bad_joins(sides):
    a, b = sides
    for f in (lambda: J.nested_loop_join(a, b, J.JoinType.INNER), lambda: J.nested_loop_join(a, b, J.JoinType.CROSS, a.a == b.b), lambda: J.hash_join(a, b, J.JoinType.INNER, ["a"], []), lambda: J.merge_join(a, b, J.JoinType.CROSS, ["a"], ["b"])):
        with pytest.raises(J.InvalidJoinCondition):
            f()


def test_pushdown_and_pruning(spark):
    p = plan(R.index_scan(R.seq_scan(spark, f"{D}/orders.parquet"), "o_orderkey", 100, 200).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderkey,100)" in p and "LessThan(o_orderkey,200)" in p
    assert "ReadSchema: struct<o_orderkey:bigint>" in p


def test_index_layout_prunes_buckets(spark):
    old = spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        R.write_indexed(R.seq_scan(spark, f"{D}/orders.parquet"), "orders_ix", "o_orderkey", 4)
        hit = R.index_get(spark.table("orders_ix"), "o_orderkey", 7)
        assert "SelectedBucketsCount: 1 out of 4" in plan(hit) and hit.count() == 1
    finally:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", old)
        spark.sql("DROP TABLE IF EXISTS orders_ix")


def test_unique_lookup(spark):
    with pytest.raises(R.NotUnique):
        R.index_get(R.seq_scan(spark, f"{D}/lineitem.parquet"), "l_linenumber", 1)


def test_topk_and_cross_to_equi(spark):
    o = R.seq_scan(spark, f"{D}/orders.parquet")
    assert "TakeOrderedAndProject" in plan(R.limit(R.sort(o, ("o_orderkey", True)), 5))
    n, r = R.seq_scan(spark, f"{D}/nation.parquet"), R.seq_scan(spark, f"{D}/region.parquet")
    assert "Cartesian" not in plan(R.cross_product(n, r).filter("n_regionkey = r_regionkey"))


def test_nulls_last_both_ways(spark):
    v = spark.sql("SELECT * FROM VALUES (1), (NULL), (2) AS v(k)")
    assert [x.k for x in R.sort(v, ("k", True)).collect()] == [1, 2, None]
    assert [x.k for x in R.sort(v, ("k", False)).collect()] == [2, 1, None]
