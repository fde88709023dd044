"""What the operators share: cutting lineage into the shared folder and Arrow batch functions."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What ``bytes.split()`` splits at is exactly space and \\x09-\\x0D, the separators of words here.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that a Python worker turns into objects at once; a longer row is a slice of its own.
SLICE = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines of a cluster see. Where it is unset (tests on one
    machine) a temporary folder takes its place and is set as the checkpoint folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='stonefly-')}")
    return at.rstrip("/")


_own: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written in the shared folder in place of lineage; an executor's loss costs no recomputation past them.

    ``cut`` writes and rereads. ``drop`` deletes those that no later plan reads; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_forget, spark, self.root)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        at = self.path()
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            remove(self.spark, df._scratch_path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            remove(spark, path)
    except Exception:  # noqa: BLE001 the gateway may be gone as the driver ends
        pass


def _sizes(col: pa.Array) -> np.ndarray:
    """Bytes of each value: exact for text, else the mean of the column."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        return pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    return np.full(len(col), col.nbytes // max(1, len(col)) + 1, np.int64)


def give_back() -> None:
    """Hand what a task has freed to the system: Spark keeps Python workers, and an idle one counts with all that it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes, so that what Python makes of one stays small however large
    the batches that Spark sends. What a task has freed goes back to the system at its end."""
    most = most or SLICE
    for b in batches:
        if b.num_rows < 2 or b.nbytes <= most:
            yield b
            continue
        upto = np.cumsum(sum(map(_sizes, b.columns)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
    give_back()


def map_batches(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list | pa.Array]], schema: T.StructType | str, binary: tuple[str, ...] = ("text",), done: Callable[[], None] | None = None) -> DataFrame:
    """Per slice of an Arrow batch, ``f`` turns columns (lists) into columns (lists or arrays). Columns in ``binary`` come as
    UTF-8 bytes. ``done`` is called when a task has no more rows, to drop what it kept."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in slices(batches):
            cols = {}
            for name, col in zip(b.schema.names, b.columns, strict=True):
                cols[name] = (col.cast(pa.binary()) if name in binary and not pa.types.is_binary(col.type) else col).to_pylist()
            out = f(cols)
            yield pa.RecordBatch.from_arrays([out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], x.type) for x in arrow], schema=arrow)
        if done:
            cols = out = None
            done()
            give_back()

    return df.mapInArrow(run, schema)


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def input_table(spark: SparkSession, d: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder ``d``. ``spread``: if it has fewer splits than the session has cores, its rows are dealt
    anew over all of them, which pays where the work on a row is far more than moving it."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
