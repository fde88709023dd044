"""Change feed of a versioned table: what transactions committed, in the order of their commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stonefly.plans.dml import RID, Store
from stonefly.session import Engine

_STATE = "committed array<struct<txn: bigint, seq: bigint>>"


def commits(engine: Engine, after: int = 0) -> DataFrame:
    """``txn``, ``seq`` of all commits after a place in their order."""
    states = engine.spark.read.schema(_STATE).json(f"{engine.root}/txns/{engine.txns.PREFIX}*")
    return states.select(F.explode("committed").alias("c")).select("c.txn", "c.seq").filter(F.col("seq") > after)


def changes(engine: Engine, table: str, of_commits: DataFrame) -> DataFrame:
    """of_commits: ``txn``, ``seq``. The rows that these wrote and deleted: ``op`` (insert or delete; an update is both), ``seq``,
    the columns of the table and the row's id. Rows that no manifest names, of aborted or open transactions, are not there."""
    info = engine.catalog.table(table)
    m = Store(engine.spark, info.path).read_manifest()
    # a batch of commits is a handful of ids; only their segments are read
    of = {r.txn: r.seq for r in of_commits.collect()}
    seq = lambda c: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col(c)] if of else F.lit(None)
    mine = lambda names: [s for s in names if m["of"][s] in of]
    data = lambda names: engine.tables._data(info, [f"{info.path}/{s}" for s in names])
    new = data(mine(m["data"])).withColumns({"op": F.lit("insert"), "seq": seq("_xmin").cast("bigint")})
    gone = engine.tables._stones(info, mine(m["gone"])).withColumn("seq", seq("_xmax").cast("bigint"))
    segments = {r[0] for r in gone.select("_seg").distinct().collect()}  # as many as there are statements
    old = data([s for s in m["data"] if int(s.split("-")[1]) in segments]).join(gone, list(RID)).withColumn("op", F.lit("delete"))
    columns = ["op", "seq", *[c.name for c in info.columns], *RID]
    return new.select(*columns).unionByName(old.select(*columns))


def follow(engine: Engine, table: str, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """``handle`` gets the changes of each batch of commits with its number, which repeats if a batch does. The checkpoint
    remembers the position, the counterpart of reading a log from a place in it."""
    spark = engine.spark
    states = spark.readStream.schema(_STATE).json(f"{engine.root}/txns/{engine.txns.PREFIX}*")
    new = states.select(F.explode("committed").alias("c")).select("c.txn", "c.seq")
    start = new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: handle(changes(engine, table, df), n))
    return start.trigger(**(trigger or {"availableNow": True})).start()
