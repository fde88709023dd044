import pytest
from pyspark.sql import functions as F

from stonefly.functions.expr import BinaryOp, ColumnNotFound, TypeMismatch, UnaryOp, binary, common_type, literal, ref, unary
from stonefly.functions.types import DType, InvalidTypeTag, TupleLayout, from_spark, from_sql_name
from stonefly.operators.relational import values
from stonefly.sources.catalog import SYS_COLUMNS, SYS_INDEXES, SYS_TABLES


def test_tags():
    assert [d.name for d in map(DType.from_tag, range(12))] == "BOOL I8 I16 I32 I64 U8 U16 U32 U64 F32 F64 STRING".split()
    for bad in (12, 255):
        with pytest.raises(InvalidTypeTag):
            DType.from_tag(bad)
    assert all(from_sql_name(d.duckdb) is d for d in DType)
    assert from_spark(DType.I64.spark) is DType.I64


def test_layouts():
    tables, columns, indexes = (TupleLayout.of(list(s)) for s in (SYS_TABLES, SYS_COLUMNS, SYS_INDEXES))
    assert (tables.bitmap_at, tables.bitmap_bytes, tables.fixed_len) == (16, 1, 32)
    assert tables.offsets == {"oid": 20, "name": 24, "file_id": 28}
    assert columns.offsets == {"oid": 20, "table_oid": 24, "name": 28, "type_id": 32, "position": 34, "nullable": 36} and columns.fixed_len == 37
    assert indexes.fixed_len == 36


@pytest.mark.parametrize("dtype", list(DType))
def test_literal_and_null_of_each_type(spark, dtype):
    v = {DType.BOOL: True, DType.STRING: "s"}.get(dtype, 7 if dtype.is_integer else 0.5)
    df = spark.range(1).select(literal(v, dtype).alias("v"), literal(None, dtype).alias("n"))
    assert df.schema["v"].dataType == df.schema["n"].dataType == dtype.spark
    row = df.first()
    assert row.v == v and row.n is None
    if dtype.bounds:
        with pytest.raises(TypeMismatch):
            literal(dtype.bounds[1] + 1, dtype)


RESULTS = {
    BinaryOp.ADD: 9, BinaryOp.SUBTRACT: 5, BinaryOp.MULTIPLY: 14, BinaryOp.DIVIDE: 3.5, BinaryOp.MODULO: 1, BinaryOp.EQ: False, BinaryOp.NOT_EQ: True,
    BinaryOp.LT: False, BinaryOp.LT_EQ: False, BinaryOp.GT: True, BinaryOp.GT_EQ: True,
}


@pytest.mark.parametrize("op", list(BinaryOp))
def test_every_binary(spark, op):
    kind = DType.I32 if op in RESULTS else DType.BOOL
    a, b = (literal(7, kind), literal(2, kind)) if op in RESULTS else (literal(True, kind), literal(False, kind))
    e = binary(op, a, b)
    assert spark.range(1).select(e.alias("v")).first().v == RESULTS.get(op, op is BinaryOp.OR)
    assert spark.range(1).select(binary(op, a, literal(None, kind)).alias("v")).first().v is (True if op is BinaryOp.OR else None)


@pytest.mark.parametrize("op", list(UnaryOp))
def test_every_unary(spark, op):
    e = unary(op, literal(3, DType.I32) if op is UnaryOp.NEGATE else literal(None, DType.BOOL))
    assert spark.range(1).select(e.alias("v")).first().v == {UnaryOp.NEGATE: -3, UnaryOp.NOT: None, UnaryOp.IS_NULL: True, UnaryOp.IS_NOT_NULL: False}[op]


def test_widening():
    assert common_type(DType.U8, DType.I8) is DType.I16
    assert common_type(DType.U8, DType.U32) is DType.U32
    assert common_type(DType.U64, DType.I64) is DType.I64
    assert common_type(DType.I64, DType.F32) is DType.F64
    with pytest.raises(TypeMismatch):
        common_type(DType.STRING, DType.I32)
    assert binary(BinaryOp.DIVIDE, literal(1.0, DType.F32), literal(3.0, DType.F32)).dtype is DType.F32


@pytest.mark.parametrize(
    ("op", "a", "b"),
    [(BinaryOp.ADD, (200, DType.U8), (100, DType.U8)), (BinaryOp.SUBTRACT, (1, DType.U32), (2, DType.U32)), (BinaryOp.ADD, (2**64 - 1, DType.U64), (1, DType.U64)), (BinaryOp.DIVIDE, (1, DType.I32), (0, DType.I32)), (BinaryOp.MODULO, (1, DType.I32), (0, DType.I32)), (BinaryOp.ADD, (2**63 - 1, DType.I64), (1, DType.I64)), (BinaryOp.ADD, (127, DType.I8), (1, DType.I8))],
)
def test_out_of_range_fails(spark, op, a, b):
    with pytest.raises(Exception, match="out of range|BY_ZERO|OVERFLOW"):
        spark.range(1).select(binary(op, literal(*a), literal(*b)).alias("v")).collect()


def test_errors(spark):
    df = spark.range(1)
    with pytest.raises(ColumnNotFound):
        ref(df, "nope")
    with pytest.raises(TypeMismatch):
        unary(UnaryOp.NOT, literal(1, DType.I32))
    with pytest.raises(TypeMismatch):
        binary(BinaryOp.ADD, literal("a", DType.STRING), literal("b", DType.STRING))
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        df.filter(~F.lit(1)).collect()


def test_unsigned_values(spark):
    v = values(spark, [(255, 2**64 - 1), (None, None)], [("a", DType.U8), ("b", DType.U64)])
    assert [tuple(r) for r in v.collect()][1] == (None, None)
    with pytest.raises(Exception, match="out of range"):
        values(spark, [(256,)], [("a", DType.U8)]).collect()
