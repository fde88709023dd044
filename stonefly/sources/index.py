"""Indexes as a sorted layout with a root: which file holds which range of keys.

``write_sorted`` deals rows by ranges of the key, so each file holds a range of
its own; a key that is very common is split over several. The root has one row
a file with its least and largest key. A lookup reads the root and opens only
the files that can hold its keys, where row groups are skipped in turn.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the root that the driver keeps; a larger root is searched by Spark at each lookup.
KEPT = 200_000


def write_sorted(df: DataFrame, key: str, path: str, parts: int | None = None) -> None:
    """``parts``: files, at best of 128 to 512 MB; without it AQE sizes them."""
    order = [F.col(key), F.xxhash64(*df.columns)]
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(key).write.parquet(path)


def write_root(spark: SparkSession, path: str, key: str) -> None:
    """The root of the files under ``path``, beside it. Reads the key's column alone; NULL keys are in no range."""
    files = spark.read.parquet(path).filter(F.col(key).isNotNull()).groupBy(F.col("_metadata.file_path").alias("file"))
    files.agg(F.min(key).alias("low"), F.max(key).alias("high")).repartition(1).sortWithinPartitions("low", "high").write.mode("overwrite").parquet(root_of(path, key))


def root_of(path: str, key: str) -> str:
    return f"{path}.root-{key}"


@lru_cache(maxsize=256)
def _kept(spark: SparkSession, root: str) -> tuple[list, list, list] | None:
    """Files, least and largest keys in order of the least keys; None if there are too many. A root never changes."""
    rows = spark.read.parquet(root).limit(KEPT + 1).collect()
    if len(rows) > KEPT:
        return None
    rows.sort(key=lambda r: (r.low, r.high))
    return [r.file for r in rows], [r.low for r in rows], [r.high for r in rows]


def files(spark: SparkSession, path: str, key: str, start=None, end=None, closed: bool = False) -> list[str]:
    """Files with keys of ``start`` up to ``end``, that end included if ``closed``; either may be open."""
    root = root_of(path, key)
    kept = _kept(spark, root)
    if kept is None:
        r = spark.read.parquet(root)
        r = r if start is None else r.filter(F.col("high") >= start)
        r = r if end is None else r.filter(F.col("low") <= end if closed else F.col("low") < end)
        return [x.file for x in r.select("file").toLocalIterator()]
    names, low, high = kept
    upto = len(low) if end is None else (bisect_right if closed else bisect_left)(low, end)
    return [n for n, h in zip(names[:upto], high[:upto], strict=True) if start is None or h >= start]
