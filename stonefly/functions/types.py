"""The twelve scalar types: tags, Spark and DuckDB counterparts, ranges and the tuple layout.

Spark has no unsigned types, so an unsigned type lives in the next wider signed
one (U64 in DECIMAL(20,0)) and is range-checked wherever a value can leave it.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InvalidTypeTag(ValueError):
    """A tag byte that names none of the twelve types."""


class DType(Enum):
    BOOL = 0
    I8 = 1
    I16 = 2
    I32 = 3
    I64 = 4
    U8 = 5
    U16 = 6
    U32 = 7
    U64 = 8
    F32 = 9
    F64 = 10
    STRING = 11

    @classmethod
    def from_tag(cls, tag: int) -> DType:
        try:
            return cls(tag)
        except ValueError:
            raise InvalidTypeTag(f"no type has tag {tag}") from None

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def duckdb(self) -> str:
        return _DUCKDB[self]

    @property
    def is_float(self) -> bool:
        return self in (DType.F32, DType.F64)

    @property
    def is_unsigned(self) -> bool:
        return self in _UNSIGNED_BITS

    @property
    def is_integer(self) -> bool:
        return self.is_unsigned or self in _SIGNED

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_float

    @property
    def bounds(self) -> tuple[int, int] | None:
        """Smallest and largest value of an integer type, None for the others."""
        if self.is_unsigned:
            return 0, 2 ** _UNSIGNED_BITS[self] - 1
        if self in _SIGNED:
            half = 2 ** (8 * 2 ** _SIGNED.index(self) - 1)
            return -half, half - 1
        return None

    @property
    def width(self) -> tuple[int, int]:
        """Bytes and alignment of the fixed part of a stored value."""
        return _WIDTH[self]


_SIGNED = [DType.I8, DType.I16, DType.I32, DType.I64]
_UNSIGNED_BITS = {DType.U8: 8, DType.U16: 16, DType.U32: 32, DType.U64: 64}
_SPARK = {
    DType.BOOL: T.BooleanType(), DType.I8: T.ByteType(), DType.I16: T.ShortType(), DType.I32: T.IntegerType(),
    DType.I64: T.LongType(), DType.U8: T.ShortType(), DType.U16: T.IntegerType(), DType.U32: T.LongType(),
    DType.U64: T.DecimalType(20, 0), DType.F32: T.FloatType(), DType.F64: T.DoubleType(), DType.STRING: T.StringType(),
}
_DUCKDB = {
    DType.BOOL: "BOOLEAN", DType.I8: "TINYINT", DType.I16: "SMALLINT", DType.I32: "INTEGER", DType.I64: "BIGINT",
    DType.U8: "UTINYINT", DType.U16: "USMALLINT", DType.U32: "UINTEGER", DType.U64: "UBIGINT", DType.F32: "FLOAT",
    DType.F64: "DOUBLE", DType.STRING: "VARCHAR",
}
_WIDTH = {
    DType.BOOL: (1, 1), DType.I8: (1, 1), DType.U8: (1, 1), DType.I16: (2, 2), DType.U16: (2, 2), DType.I32: (4, 4),
    DType.U32: (4, 4), DType.F32: (4, 4), DType.STRING: (4, 4), DType.I64: (8, 8), DType.U64: (8, 8), DType.F64: (8, 8),
}
_SQL_NAMES = {
    "BOOLEAN": DType.BOOL, "BOOL": DType.BOOL, "TINYINT": DType.I8, "SMALLINT": DType.I16, "INT": DType.I32,
    "INTEGER": DType.I32, "BIGINT": DType.I64, "UTINYINT": DType.U8, "USMALLINT": DType.U16, "UINTEGER": DType.U32,
    "UBIGINT": DType.U64, "FLOAT": DType.F32, "REAL": DType.F32, "DOUBLE": DType.F64, "VARCHAR": DType.STRING,
    "STRING": DType.STRING, "TEXT": DType.STRING,
}


def from_sql_name(name: str) -> DType:
    """A SQL type name (``BIGINT``, ``UTINYINT``...) as one of the twelve types."""
    key = name.strip().upper()
    if key not in _SQL_NAMES:
        raise ValueError(f"type {name!r} is none of the twelve scalar types")
    return _SQL_NAMES[key]


def from_spark(kind: T.DataType) -> DType | None:
    """The type stored in this Spark type by default; None for those that only pass through (timestamps, lists)."""
    for d in (DType.BOOL, *_SIGNED, DType.F32, DType.F64, DType.STRING, DType.U64):
        if d.spark == kind:
            return d
    return None


def checked(value: Column, dtype: DType) -> Column:
    """``value`` cast to ``dtype``; a value outside an unsigned range fails the query."""
    if dtype.is_unsigned:
        low, high = dtype.bounds
        bound = F.lit(str(high)).cast(dtype.spark) if dtype is DType.U64 else F.lit(high)
        value = F.when((value < F.lit(low)) | (value > bound), F.raise_error(F.lit(f"value out of range for {dtype.name}"))).otherwise(value)
    return value.cast(dtype.spark)


@dataclass(frozen=True)
class TupleLayout:
    """Where the fields of a stored tuple would start: header, null bitmap, aligned fixed part.

    Only sizing estimates need it here, since the data itself lives in Parquet.
    """

    bitmap_at: int
    bitmap_bytes: int
    offsets: dict[str, int]
    fixed_len: int

    HEADER = 16

    @classmethod
    def of(cls, columns: list[tuple[str, DType]]) -> TupleLayout:
        """``columns`` in position order."""
        bitmap = (len(columns) + 7) // 8
        at, offsets = cls.HEADER + bitmap, {}
        for name, dtype in columns:
            length, align = dtype.width
            at += -at % align
            offsets[name] = at
            at += length
        return cls(cls.HEADER, bitmap, offsets, at)
