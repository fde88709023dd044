"""CREATE, DROP, INSERT, UPDATE and DELETE over versioned Parquet tables.

A table is a directory of immutable segments. An insert adds a data segment, a
delete adds a tombstone segment naming (segment, row) pairs, an update does
both. Nothing is rewritten. A manifest per commit, published under a number that
only one writer can take, makes a commit all or nothing; a lost executor only
means a retried task inside a segment that no manifest names yet.

A row may have several tombstones, of writers that aborted or are open. Each is
judged for itself: a row is gone for a reader who sees one of its deleters. A
writer whose rows have a tombstone of another that did not abort fails
(``WriteConflict``), and so the first of two writers of a row wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonefly.functions.types import checked
from stonefly.plans.txn import Isolation, TupleNonExistent, TupleNotVisible, Txn, TxnManager, WriteConflict
from stonefly.sources import index
from stonefly.sources.catalog import Catalog, IndexInfo, TableInfo
from stonefly.sources.publish import publish, read_bytes

#: Columns that identify a stored version: segment number and row within it.
RID = ("_seg", "_row")


class ConstraintViolation(ValueError):
    pass


class CommitConflict(RuntimeError):
    """Another writer has published this version of the table."""


class Store:
    """Segments and manifests of one table on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(self.path)
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))

    def read_manifest(self) -> dict:
        """The last version published; those before it stay readable until ``vacuum``. ``of`` has the transaction of each segment."""
        known = self._manifests()
        if not known:
            return {"version": 0, "data": [], "gone": [], "of": {}}
        return json.loads(read_bytes(self.spark, self._name(known[-1])).decode())

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest-{version:012d}"

    def commit(self, manifest: dict) -> None:
        """Publish under a number that must be free, so there is a whole manifest at any moment and a second writer of the same version fails."""
        if not publish(self.spark, self._name(manifest["version"]), json.dumps(manifest).encode()):
            raise CommitConflict(f"version {manifest['version']} of {self.path} is published already")

    def next_segment(self, manifest: dict) -> int:
        """A segment number that no writer, also of another session, has or had."""
        n = 1 + max((int(x.split("-")[1]) for x in (*manifest["data"], *manifest["gone"])), default=0)
        while not publish(self.spark, f"{self.path}/segment-{n:06d}", b""):
            n += 1
        return n

    def vacuum(self, keep: int = 1) -> None:
        """Drop all manifests but the last ``keep``, and segments and drafts that none of these names."""
        kept = self._manifests()[-keep:]
        named = {f"manifest-{v:012d}" for v in kept}
        last = 0
        for v in kept:
            m = json.loads(read_bytes(self.spark, self._name(v)).decode())
            named |= {*m["data"], *m["gone"]}
            last = max([last, *(int(x.split("-")[1]) for x in m["data"] + m["gone"])])
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name.startswith("segment-") and int(name.split("-")[1]) >= last or name.split(".")[0] in named:
                continue
            self._fs.delete(f.getPath(), True)

    def remove(self) -> None:
        self._fs.delete(self._path(self.path), True)


class Tables:
    """Statements against the versioned tables of one catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, root: str, txns: TxnManager | None = None):
        self.spark, self.catalog, self.root, self.txns = spark, catalog, root, txns or TxnManager()

    def create(self, name: str, columns: Sequence[tuple], primary_key: Sequence[str] = ()) -> TableInfo:
        """columns: (name, type[, nullable[, default SQL]])."""
        fields = [(c[0], c[1], c[2] if len(c) > 2 else True, c[3] if len(c) > 3 else None) for c in columns]
        fields = [(n, d, nullable and n not in primary_key, default) for n, d, nullable, default in fields]
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        Store(self.spark, path).commit({"version": 0, "data": [], "gone": [], "of": {}})
        return self.catalog.add_table(name, fields, path, list(primary_key), versioned=True)

    def drop(self, name: str) -> None:
        info = self.catalog.drop_table(name)
        Store(self.spark, info.path).remove()

    def create_index(self, name: str, table: str, column: str) -> IndexInfo:
        """Each segment has a root for the column, those to come too, and those are sorted by the first index of the table."""
        info = self.catalog.table(table)
        self.catalog.column(info, column)
        for s in Store(self.spark, info.path).read_manifest()["data"]:
            index.write_root(self.spark, f"{info.path}/{s}", column)
        return self.catalog.add_index(name, table, column)

    # reading

    def _schema(self, info: TableInfo) -> T.StructType:
        fields = [T.StructField(c.name, c.dtype.spark, True) for c in info.columns]
        return T.StructType([*fields, T.StructField("_seg", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_xmin", T.LongType())])

    def _data(self, info: TableInfo, files: list[str]) -> DataFrame:
        schema = self._schema(info)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _stones(self, info: TableInfo, segments: list[str]) -> DataFrame:
        """Every tombstone: ``_seg``, ``_row``, ``_xmax``."""
        schema = T.StructType([T.StructField("_seg", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_xmax", T.LongType())])
        return self.spark.read.schema(schema).parquet(*[f"{info.path}/{s}" for s in segments]) if segments else self.spark.createDataFrame([], schema)

    def _visible(self, info: TableInfo, data: DataFrame, m: dict, txn: Txn) -> DataFrame:
        rows = data.filter(self.txns.seen(txn, F.col("_xmin")))
        if not m["gone"]:
            return rows
        return rows.join(self._stones(info, m["gone"]).filter(self.txns.seen(txn, F.col("_xmax"))).select(*RID), list(RID), "left_anti")

    def scan(self, name: str, txn: Txn | None = None, with_rid: bool = False, manifest: dict | None = None) -> DataFrame:
        """The rows ``txn`` sees; without one, all that is committed now."""
        info = self.catalog.table(name)
        self.txns.refresh()
        m = manifest or Store(self.spark, info.path).read_manifest()
        df = self._visible(info, self._data(info, [f"{info.path}/{s}" for s in m["data"]]), m, txn or Txn(-1, Isolation.READ_COMMITTED))
        return df.select(*[c.name for c in info.columns], *(RID if with_rid else ()))

    def index_scan(self, name: str, start=None, end=None, txn: Txn | None = None, closed: bool = False) -> DataFrame:
        """Rows that ``txn`` sees with ``start <= key < end`` (or ``<= end``), from the files whose ranges meet it."""
        ix = self.catalog.index(name)
        info, key = self.catalog.table_by_oid(ix.table_oid), self.catalog.key_of(ix)
        self.txns.refresh()
        m = Store(self.spark, info.path).read_manifest()
        files = [f for s in m["data"] for f in index.files(self.spark, f"{info.path}/{s}", key, start, end, closed)]
        data = self._data(info, files).filter(F.col(key).isNotNull())
        data = data if start is None else data.filter(F.col(key) >= start)
        data = data if end is None else data.filter(F.col(key) <= end if closed else F.col(key) < end)
        return self._visible(info, data, m, txn or Txn(-1, Isolation.READ_COMMITTED)).select(*[c.name for c in info.columns])

    def get(self, name: str, rid: tuple[int, int], txn: Txn | None = None) -> tuple:
        """Point fetch by record id."""
        info = self.catalog.table(name)
        here = (F.col("_seg") == rid[0]) & (F.col("_row") == rid[1])
        row = self.scan(name, txn, with_rid=True).filter(here).drop(*RID).take(1)
        if row:
            return tuple(row[0])
        m = Store(self.spark, info.path).read_manifest()
        known = self._data(info, [f"{info.path}/{s}" for s in m["data"]]).filter(here).take(1)
        raise (TupleNotVisible if known else TupleNonExistent)(f"{name} {rid}")

    # writing

    def _run(self, txn: Txn | None, work) -> None:
        """Inside ``txn``, or in one of its own that commits at the end."""
        own = self.txns.begin(Isolation.READ_COMMITTED) if txn is None else txn
        try:
            work(own)
        except Exception:
            if txn is None:
                self.txns.abort(own)
            raise
        if txn is None:
            self.txns.commit(own)

    def _append(self, info: TableInfo, rows: DataFrame | None, txn: Txn, m: dict, gone: DataFrame | None = None, keys_change: bool = True) -> None:
        """Add segments to the table that was read as manifest ``m``, or to what others have made of it since."""
        store = Store(self.spark, info.path)
        seg = store.next_segment(m)
        data = stones = None
        if rows is not None:
            data = f"data-{seg:06d}-{uuid.uuid4().hex[:8]}"
            keys = [self.catalog.key_of(i) for i in self.catalog.indexes_of(info)]
            own = rows.select(*[c.name for c in info.columns])
            own = own.repartitionByRange(keys[0], F.xxhash64(*own.columns)).sortWithinPartitions(keys[0]) if keys else own
            # the id is fixed once written; task order cannot change it later
            strict, primary = [c.name for c in info.columns if not c.nullable], info.primary_key
            told = Observation()  # counted as the rows are written, so the constraints need no job of their own
            own = own.observe(told, F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in strict], *[f(k).alias(f"{f.__name__}_{k}") for k in primary for f in (F.min, F.max)])
            own.select("*", F.lit(seg).alias("_seg"), F.monotonically_increasing_id().alias("_row"), F.lit(txn.id).cast("bigint").alias("_xmin")).write.parquet(f"{info.path}/{data}")
            ends = told.get
            if bad := [c for c in strict if ends[f"null_{c}"]]:
                raise ConstraintViolation(f"NULL in {', '.join(bad)} of {info.name}")
            for key in dict.fromkeys(keys):
                index.write_root(self.spark, f"{info.path}/{data}", key)
        if gone is not None:
            stones = f"gone-{seg:06d}-{uuid.uuid4().hex[:8]}"
            gone.select(*RID, F.lit(txn.id).cast("bigint").alias("_xmax")).write.parquet(f"{info.path}/{stones}")
        while True:
            # what is checked here is what the manifest published next follows
            m = store.read_manifest()
            self.txns.refresh()
            if stones and m["gone"]:
                self._no_conflict(info, m, stones, txn)
            if data and keys_change and info.primary_key:
                self._unique(info, m, data, stones, txn, ends)
            new = {"version": m["version"] + 1, "data": m["data"] + [data] * bool(data), "gone": m["gone"] + [stones] * bool(stones), "of": m["of"] | {s: txn.id for s in (data, stones) if s}}
            try:
                return store.commit(new)
            except CommitConflict:
                continue

    def _no_conflict(self, info: TableInfo, m: dict, stones: str, txn: Txn) -> None:
        others = self._stones(info, m["gone"]).filter(~F.col("_xmax").isin([*self.txns.aborted(), txn.id]))
        if self._stones(info, [stones]).join(others, list(RID), "left_semi").take(1):
            raise WriteConflict(f"another transaction has changed a row of {info.name} that transaction {txn.id} changes")

    def _unique(self, info: TableInfo, m: dict, segment: str, stones: str | None, txn: Txn, ends: dict) -> None:
        """PRIMARY KEY of a segment that no manifest names yet. The key counts as taken by a row of any transaction that
        did not abort, until a deleter commits; keys outside the range of the new ones are not read."""
        keys = info.primary_key
        new = self.spark.read.parquet(f"{info.path}/{segment}").select(*keys)
        if not m["data"]:
            if new.groupBy(*keys).count().filter("count > 1").take(1):
                raise ConstraintViolation(f"duplicate primary key in {info.name}")
            return
        old = self._data(info, [f"{info.path}/{s}" for s in m["data"]]).filter(~F.col("_xmin").isin(self.txns.aborted()))
        for k in keys:
            if ends[f"min_{k}"] is not None:
                old = old.filter(F.col(k).between(ends[f"min_{k}"], ends[f"max_{k}"]))
        dead = self._stones(info, m["gone"]).filter(self.txns.seen(Txn(txn.id, Isolation.READ_COMMITTED), F.col("_xmax"))).select(*RID)
        dead = dead.unionByName(self._stones(info, [stones]).select(*RID)) if stones else dead
        old = old.select(*keys, *RID).join(dead, list(RID), "left_anti") if m["gone"] or stones else old
        # only stored rows that share a key with the new ones take part in the count
        both = new.unionByName(old.select(*keys).join(new.distinct(), keys, "left_semi"))
        if both.groupBy(*keys).count().filter("count > 1").take(1):
            raise ConstraintViolation(f"duplicate primary key in {info.name}")

    def insert(self, name: str, rows: DataFrame, columns: Sequence[str] | None = None, txn: Txn | None = None) -> None:
        """Append rows; ``columns`` names their target columns by position. An omitted column takes its default, else NULL."""
        info = self.catalog.table(name)
        targets = list(columns or [c.name for c in info.columns])
        if len(targets) != len(rows.columns):
            raise ValueError(f"{len(rows.columns)} values for {len(targets)} columns")
        for t in targets:
            self.catalog.column(info, t)
        named = rows.toDF(*targets)
        out = [checked(F.col(c.name), c.dtype) if c.name in targets else F.expr(c.default or "NULL").cast(c.dtype.spark) for c in info.columns]
        full = named.select(*[e.alias(c.name) for e, c in zip(out, info.columns, strict=True)])
        self._run(txn, lambda t: self._append(info, full, t, Store(self.spark, info.path).read_manifest()))

    def delete(self, name: str, where: Column | None = None, txn: Txn | None = None) -> None:
        """Rows for which the predicate is NULL stay."""
        info = self.catalog.table(name)

        def work(t: Txn) -> None:
            m = Store(self.spark, info.path).read_manifest()
            hit = self.scan(name, t, with_rid=True, manifest=m)
            self._append(info, None, t, m, (hit if where is None else hit.filter(where)).select(*RID))

        self._run(txn, work)

    def update(self, name: str, assignments: dict[str, Column], where: Column | None = None, txn: Txn | None = None) -> None:
        """All right sides see the old row. Keys are checked only where one is assigned."""
        info = self.catalog.table(name)
        for c in assignments:
            self.catalog.column(info, c)

        def work(t: Txn) -> None:
            m = Store(self.spark, info.path).read_manifest()
            hit = self.scan(name, t, with_rid=True, manifest=m)
            hit = hit if where is None else hit.filter(where)
            new = hit.select(*[(checked(assignments[c.name], c.dtype) if c.name in assignments else F.col(c.name)).alias(c.name) for c in info.columns])
            self._append(info, new, t, m, hit.select(*RID), keys_change=bool(set(assignments) & set(info.primary_key)))

        self._run(txn, work)
