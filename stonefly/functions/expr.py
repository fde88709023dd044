"""Typed scalar expressions: literals, column references, 4 unary and 13 binary operators.

Every expression carries one of the twelve types beside its Spark ``Column``,
so types are checked and unsigned ranges are guarded before Catalyst sees the
tree. Everything stays a built-in expression, hence inside whole-stage codegen
and open to pushdown.

Fixed semantics: three-valued logic; ``/`` of integers is a double; ``%`` takes
the dividend's sign; division by zero and overflow fail the query; numbers
widen but never compare with strings.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonefly.functions.types import DType, checked, from_spark


class TypeMismatch(TypeError):
    def __init__(self, expected: str, found: str):
        super().__init__(f"expected {expected}, found {found}")
        self.expected, self.found = expected, found


class ColumnNotFound(KeyError):
    pass


class UnaryOp(Enum):
    NOT = "NOT"
    NEGATE = "-"
    IS_NULL = "IS NULL"
    IS_NOT_NULL = "IS NOT NULL"


class BinaryOp(Enum):
    ADD = "+"
    SUBTRACT = "-"
    MULTIPLY = "*"
    DIVIDE = "/"
    MODULO = "%"
    EQ = "="
    NOT_EQ = "<>"
    LT = "<"
    LT_EQ = "<="
    GT = ">"
    GT_EQ = ">="
    AND = "AND"
    OR = "OR"


_APPLY = {
    BinaryOp.ADD: operator.add, BinaryOp.SUBTRACT: operator.sub, BinaryOp.MULTIPLY: operator.mul,
    BinaryOp.DIVIDE: operator.truediv, BinaryOp.MODULO: operator.mod, BinaryOp.EQ: operator.eq,
    BinaryOp.NOT_EQ: operator.ne, BinaryOp.LT: operator.lt, BinaryOp.LT_EQ: operator.le, BinaryOp.GT: operator.gt,
    BinaryOp.GT_EQ: operator.ge, BinaryOp.AND: operator.and_, BinaryOp.OR: operator.or_,
}
_ARITHMETIC = {BinaryOp.ADD, BinaryOp.SUBTRACT, BinaryOp.MULTIPLY, BinaryOp.DIVIDE, BinaryOp.MODULO}
_LOGICAL = {BinaryOp.AND, BinaryOp.OR}


@dataclass(frozen=True)
class Expr:
    column: Column
    dtype: DType

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


def literal(value, dtype: DType) -> Expr:
    """A constant of the given type; ``None`` is the NULL of that type."""
    if value is not None and dtype.bounds and not dtype.bounds[0] <= value <= dtype.bounds[1]:
        raise TypeMismatch(dtype.name, f"{value!r}, which is out of its range")
    if dtype is DType.U64 and value is not None:
        return Expr(F.lit(str(value)).cast(dtype.spark), dtype)
    return Expr(F.lit(value).cast(dtype.spark), dtype)


def ref(df: DataFrame, name: str, dtype: DType | None = None) -> Expr:
    """A column of ``df``; ``dtype`` says so where an unsigned type hides in a signed one."""
    plain = name.split(".")[-1]
    field = next((f for f in df.schema.fields if f.name == plain), None)
    if field is None:
        raise ColumnNotFound(name)
    found = dtype or from_spark(field.dataType)
    if found is None:
        raise TypeMismatch("one of the twelve scalar types", field.dataType.simpleString())
    return Expr(F.col(name), found)


def common_type(a: DType, b: DType) -> DType:
    """The narrowest type both sides widen to."""
    if a is b:
        return a
    if not (a.is_numeric and b.is_numeric):
        raise TypeMismatch(a.name, b.name)
    if a.is_float or b.is_float:
        narrow = {DType.F32, DType.I8, DType.I16, DType.U8, DType.U16}
        return DType.F32 if {a, b} <= narrow else DType.F64
    low, high = min(a.bounds[0], b.bounds[0]), max(a.bounds[1], b.bounds[1])
    order = [DType.U8, DType.U16, DType.U32, DType.U64] if low == 0 else [DType.I8, DType.I16, DType.I32, DType.I64]
    return next((t for t in order if t.bounds[0] <= low and t.bounds[1] >= high), DType.I64)


def unary(op: UnaryOp, e: Expr) -> Expr:
    if op is UnaryOp.IS_NULL:
        return Expr(e.column.isNull(), DType.BOOL)
    if op is UnaryOp.IS_NOT_NULL:
        return Expr(e.column.isNotNull(), DType.BOOL)
    if op is UnaryOp.NOT:
        if e.dtype is not DType.BOOL:
            raise TypeMismatch("BOOL", e.dtype.name)
        return Expr(~e.column, DType.BOOL)
    if not e.dtype.is_numeric:
        raise TypeMismatch("a number", e.dtype.name)
    return Expr(checked(-e.column, e.dtype), e.dtype)


def binary(op: BinaryOp, a: Expr, b: Expr) -> Expr:
    if op in _LOGICAL:
        for e in (a, b):
            if e.dtype is not DType.BOOL:
                raise TypeMismatch("BOOL", e.dtype.name)
        return Expr(_APPLY[op](a.column, b.column), DType.BOOL)
    shared = common_type(a.dtype, b.dtype)
    left, right = (e.column if e.dtype is shared else e.column.cast(shared.spark) for e in (a, b))
    if op not in _ARITHMETIC:
        return Expr(_APPLY[op](left, right), DType.BOOL)
    if not shared.is_numeric:
        raise TypeMismatch("a number", shared.name)
    if op is BinaryOp.DIVIDE:
        shared = DType.F32 if shared is DType.F32 else DType.F64
    return Expr(checked(_APPLY[op](left, right), shared), shared)
