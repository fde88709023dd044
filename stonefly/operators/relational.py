"""Scans, filters, projections, grouping, sorting, limits: thin shapes over DataFrames.

Each returns a lazy plan; Catalyst merges, prunes and pushes down across them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefly.functions.expr import Expr
from stonefly.functions.types import DType, checked


class NotUnique(ValueError):
    """A unique lookup met more than one row."""


def _c(e: Column | Expr | str) -> Column:
    return e.column if isinstance(e, Expr) else F.col(e) if isinstance(e, str) else e


def seq_scan(spark: SparkSession, path: str, predicate: Column | Expr | None = None) -> DataFrame:
    """Full scan of a Parquet table; the predicate reaches the reader as PushedFilters."""
    df = spark.read.parquet(path)
    return df if predicate is None else df.filter(_c(predicate))


def values(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[tuple[str, DType]]) -> DataFrame:
    """Literal rows. Values are built as text-free Python rows and range-checked by their declared types."""
    from decimal import Decimal

    names, kinds = zip(*columns, strict=True)
    fixed = [tuple(Decimal(v) if k is DType.U64 and v is not None else v for v, k in zip(r, kinds, strict=True)) for r in rows]
    ddl = ", ".join(f"`{n}` {k.spark.simpleString()}" for n, k in columns)
    df = spark.createDataFrame(fixed, ddl)
    return df.select(*[checked(F.col(n), k).alias(n) if k.is_unsigned else F.col(n) for n, k in zip(names, kinds, strict=True)])


def filter_rows(df: DataFrame, predicate: Column | Expr) -> DataFrame:
    return df.filter(_c(predicate))


def project(df: DataFrame, *exprs: Column | Expr | str) -> DataFrame:
    return df.select(*["*" if isinstance(e, str) and e == "*" else _c(e) for e in exprs])


def write_indexed(df: DataFrame, table: str, key: str, buckets: int = 16) -> None:
    """An index as a layout: bucketed and sorted by its key, so a point read prunes to one
    bucket and a range read skips row groups. ``buckets`` should leave 128-512 MB a bucket."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def index_scan(df: DataFrame, key: str, start=None, end=None, predicate: Column | None = None) -> DataFrame:
    """Rows with ``start <= key < end``; either end may be open. No sort: callers that need order ask for it."""
    bounds = [c for c in (None if start is None else F.col(key) >= start, None if end is None else F.col(key) < end, predicate) if c is not None]
    return df.filter(reduce(lambda a, b: a & b, bounds)) if bounds else df


def index_get(df: DataFrame, key: str, value) -> DataFrame:
    """Unique point lookup; more than one row is an error. Reads two rows at most for the test."""
    hit = df.filter(F.col(key) == value)
    if len(hit.select(key).take(2)) > 1:
        raise NotUnique(f"{key} = {value!r}")
    return hit


def group_having(df: DataFrame, keys: Sequence[Column | Expr | str], having: Column | None = None) -> DataFrame:
    """GROUP BY over plain expressions. A HAVING over group keys equals a filter before the
    shuffle, which Catalyst pushes below the aggregate by itself."""
    out = df.select(*[_c(k) for k in keys]).distinct()
    return out if having is None else out.filter(having)


def sort(df: DataFrame, *order: tuple[str | Column, bool]) -> DataFrame:
    """order: (expression, ascending). NULLs come last either way."""
    return df.orderBy(*[_c(e).asc_nulls_last() if asc else _c(e).desc_nulls_last() for e, asc in order])


def limit(df: DataFrame, count: int | None, offset: int = 0) -> DataFrame:
    """OFFSET first, then LIMIT. After a sort Spark fuses both into a top-k without a full sort."""
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def derived(df: DataFrame, alias: str) -> DataFrame:
    return df.alias(alias)


def cross_product(*tables: DataFrame) -> DataFrame:
    """``FROM a, b, c``. A later equality filter turns each step into an equi-join."""
    return reduce(lambda a, b: a.crossJoin(b), tables)
