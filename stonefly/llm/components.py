"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join. The minima are written before they
are joined, so Spark knows their size: small ones are broadcast under its own
threshold, and beyond that both sides are exchanged plainly, which lets AQE
split a hub's partition. Edges shrink to stars in O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefly.llm.common import Scratch


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges: columns ``a``, ``b`` (bigint, any order, repeats and loops allowed).

    Returns ``node``, ``root`` for every node that has an edge to another; root
    is the component's least node and has no row of its own. No edges: no rows.
    """
    e = scratch.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # every larger neighbour moves to the least neighbour
        large = scratch.cut(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low2 = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        new = scratch.cut(small.filter("a <> b").distinct())
        scratch.drop(e, low, large, low2)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        raise RuntimeError(f"no fixpoint within {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
