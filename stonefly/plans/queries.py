"""The query catalogue: each relational feature once, with the SQL that must give the same rows."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefly.functions.expr import BinaryOp, ColumnNotFound, TypeMismatch, UnaryOp, binary, literal, ref, unary
from stonefly.functions.types import DType, InvalidTypeTag
from stonefly.operators import joins as J
from stonefly.operators import relational as R
from stonefly.plans.dml import ConstraintViolation
from stonefly.plans.txn import Isolation, TupleNonExistent, TupleNotVisible, TxnManager, WriteConflict, visible_as_of
from stonefly.session import Engine, UnsupportedStatement, shared_folder
from stonefly.sources.catalog import CatalogNotFound, DuplicateColumn, TableExists
from stonefly.sources.publish import hadoop
from stonefly.streaming import changes, commits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return R.seq_scan(spark, f"{d}/{name}.parquet")


# flagship


@query("""SELECT c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > 400000 AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""")
def building_orders(spark, d):
    orders, customer = t(spark, d, "orders"), t(spark, d, "customer")
    price = binary(BinaryOp.GT, ref(orders, "o_totalprice"), literal(400000.0, DType.F64))
    segment = binary(BinaryOp.EQ, ref(customer, "c_mktsegment"), literal("BUILDING", DType.STRING))
    both = orders.filter(price.column).join(customer.filter(segment.column), F.col("o_custkey") == F.col("c_custkey"))
    return R.limit(R.sort(both, ("o_totalprice", False), ("o_orderkey", True)).select("c_name", "o_orderkey", "o_totalprice"), 10, 5)


# scans


@query("SELECT r_regionkey, r_name FROM region")
def seq_scan_region(spark, d):
    return t(spark, d, "region").select("r_regionkey", "r_name")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 AND l_returnflag = 'R'")
def seq_scan_pred(spark, d):
    return R.seq_scan(spark, f"{d}/lineitem.parquet", (F.col("l_quantity") < 3) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("SELECT * FROM (VALUES (1, 'a', CAST(NULL AS DOUBLE)), (2, NULL, 2.5), (3, 'c', -1.0)) AS v(id, tag, x)")
def values_rows(spark, d):
    return R.values(spark, [(1, "a", None), (2, None, 2.5), (3, "c", -1.0)], [("id", DType.I32), ("tag", DType.STRING), ("x", DType.F64)])


@query("SELECT * FROM nation")
def project_star(spark, d):
    return R.project(t(spark, d, "nation"), "*")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS q1 FROM lineitem")
def project_expr(spark, d):
    li = t(spark, d, "lineitem")
    one = literal(1, DType.I32)
    net = binary(BinaryOp.MULTIPLY, ref(li, "l_extendedprice"), binary(BinaryOp.SUBTRACT, one, ref(li, "l_discount")))
    return R.project(li, "l_orderkey", "l_linenumber", net.alias("net"), binary(BinaryOp.ADD, ref(li, "l_quantity"), one).alias("q1"))


# index scans: an index of orders is made once for each state of its file and kept in the shared folder


def _indexed(spark, d) -> Engine:
    path, fs = hadoop(spark, f"{d}/orders.parquet")
    now = fs.getFileStatus(path)
    stamp = hashlib.sha256(f"{now.getPath()}:{now.getLen()}:{now.getModificationTime()}".encode()).hexdigest()[:16]
    e = Engine(spark, f"{shared_folder(spark)}/indexed-{stamp}")
    try:
        at, fs = hadoop(spark, e.catalog.index("orders_key").path)
        if fs.exists(at):
            return e
        e.catalog.drop_table("orders")  # someone has cleared the folder
    except CatalogNotFound:
        pass
    try:
        e.register_parquet("orders", f"{d}/orders.parquet")
    except TableExists:  # by another session, which may not have made the index
        pass
    e.create_index("orders_key", "orders", "o_orderkey", files=8)
    return e


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 777")
def index_point_order(spark, d):
    return _indexed(spark, d).index_get("orders_key", 777).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def index_range_orders(spark, d):
    return _indexed(spark, d).index_scan("orders_key", 100, 200).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 250")
def index_range_open_start(spark, d):
    return _indexed(spark, d).index_scan("orders_key", None, 250).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderstatus = 'F'")
def index_range_open_end(spark, d):
    return _indexed(spark, d).index_scan("orders_key", 1000).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


# one query an operator

_ORDERS_OPS = {
    "op_add": (BinaryOp.ADD, "o_orderkey", "o_custkey"), "op_subtract": (BinaryOp.SUBTRACT, "o_orderkey", "o_custkey"),
    "op_multiply": (BinaryOp.MULTIPLY, "o_orderkey", "o_custkey"), "op_eq": (BinaryOp.EQ, "o_orderkey", "o_custkey"),
    "op_noteq": (BinaryOp.NOT_EQ, "o_orderkey", "o_custkey"), "op_lt": (BinaryOp.LT, "o_orderkey", "o_custkey"),
    "op_lteq": (BinaryOp.LT_EQ, "o_orderkey", "o_custkey"), "op_gt": (BinaryOp.GT, "o_orderkey", "o_custkey"),
    "op_gteq": (BinaryOp.GT_EQ, "o_orderkey", "o_custkey"),
}


def _pair_op(op: BinaryOp, a: str, b: str) -> Query:
    def run(spark, d):
        o = t(spark, d, "orders")
        return o.select("o_orderkey", binary(op, ref(o, a), ref(o, b)).alias("v"))

    return run


for _name, (_op, _a, _b) in _ORDERS_OPS.items():
    query(f"SELECT o_orderkey, ({_a} {_op.value} {_b}) AS v FROM orders", _name)(_pair_op(_op, _a, _b))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / (o_custkey + 1) AS v FROM orders")
def op_divide(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", binary(BinaryOp.DIVIDE, ref(o, "o_orderkey"), binary(BinaryOp.ADD, ref(o, "o_custkey"), literal(1, DType.I64))).alias("v"))


@query("SELECT o_orderkey, (0 - o_orderkey) % (o_custkey + 1) AS v FROM orders")
def op_modulo(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", binary(BinaryOp.MODULO, unary(UnaryOp.NEGATE, ref(o, "o_orderkey")), binary(BinaryOp.ADD, ref(o, "o_custkey"), literal(1, DType.I64))).alias("v"))


def _tri(spark):
    full = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    return R.values(spark, full, [("a", DType.BOOL), ("b", DType.BOOL)])


_TRI = "(VALUES (true,true),(true,false),(true,NULL),(false,true),(false,false),(false,NULL),(NULL,true),(NULL,false),(CAST(NULL AS BOOLEAN),CAST(NULL AS BOOLEAN))) AS v(a, b)"


def _logic(op) -> Query:
    def run(spark, d):
        v = _tri(spark)
        e = binary(op, ref(v, "a"), ref(v, "b")) if isinstance(op, BinaryOp) else unary(op, ref(v, "a"))
        return v.select("a", "b", e.alias("v"))

    return run


for _name, _op, _sql in (("op_and", BinaryOp.AND, "a AND b"), ("op_or", BinaryOp.OR, "a OR b"), ("op_not", UnaryOp.NOT, "NOT a"), ("op_isnull", UnaryOp.IS_NULL, "a IS NULL"), ("op_isnotnull", UnaryOp.IS_NOT_NULL, "a IS NOT NULL")):
    query(f"SELECT a, b, ({_sql}) AS v FROM {_TRI}", _name)(_logic(_op))


@query("SELECT c_custkey, -c_acctbal AS v FROM customer")
def op_negate(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", unary(UnaryOp.NEGATE, ref(c, "c_acctbal")).alias("v"))


@query(f"SELECT a, b, (a = b) AS eq, (NOT a OR b) AS implies, (a AND b) IS NULL AS unknown FROM {_TRI} WHERE (a OR b) IS NOT FALSE")
def null_three_valued(spark, d):
    v = _tri(spark)
    a, b = ref(v, "a"), ref(v, "b")
    either = binary(BinaryOp.OR, a, b).column
    return v.filter(F.coalesce(either, F.lit(True))).select("a", "b", binary(BinaryOp.EQ, a, b).alias("eq"), binary(BinaryOp.OR, unary(UnaryOp.NOT, a), b).alias("implies"), unary(UnaryOp.IS_NULL, binary(BinaryOp.AND, a, b)).alias("unknown"))


@query("""SELECT true AS b, CAST(-128 AS TINYINT) AS i8, CAST(32767 AS SMALLINT) AS i16, CAST(-2147483648 AS INTEGER) AS i32,
CAST(9223372036854775807 AS BIGINT) AS i64, CAST(0.5 AS FLOAT) AS f32, CAST(2.25 AS DOUBLE) AS f64, 'x' AS s
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def types_roundtrip(spark, d):
    cols = [("b", DType.BOOL), ("i8", DType.I8), ("i16", DType.I16), ("i32", DType.I32), ("i64", DType.I64), ("f32", DType.F32), ("f64", DType.F64), ("s", DType.STRING)]
    return R.values(spark, [(True, -128, 32767, -(2**31), 2**63 - 1, 0.5, 2.25, "x"), (None,) * 8], cols)


@query("""SELECT CAST(u8 AS SMALLINT) AS u8, CAST(u16 AS INTEGER) AS u16, CAST(u32 AS BIGINT) AS u32, CAST(u64 AS VARCHAR) AS u64
FROM (VALUES (0, 0, 0, 0), (255, 65535, 4294967295, 18446744073709551615)) AS v(u8, u16, u32, u64)""")
def unsigned_bounds(spark, d):
    v = R.values(spark, [(0, 0, 0, 0), (255, 65535, 2**32 - 1, 2**64 - 1)], [("u8", DType.U8), ("u16", DType.U16), ("u32", DType.U32), ("u64", DType.U64)])
    return v.withColumn("u64", F.col("u64").cast("string"))


# joins: every type on every algorithm that has it


def _sides(spark, d, how: J.JoinType):
    a = t(spark, d, "documents").select(F.col("doc_id").alias("a_id"), F.col("lang").alias("a_lang"))
    b = t(spark, d, "labels").select((F.col("doc_id") + 300).alias("b_id"), F.col("quality").alias("b_quality"))
    return a, b


def _join(algorithm: str, how: J.JoinType) -> Query:
    def run(spark, d):
        if algorithm == "nl":
            # suppliers and nations: a theta join over small tables
            a = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
            b = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
            return J.nested_loop_join(a, b, how, (a.s_nationkey < b.n_nationkey) & (b.n_regionkey == 1))
        a, b = _sides(spark, d, how)
        f = J.hash_join if algorithm == "hash" else J.merge_join
        return f(a, b, how, ["a_id"], ["b_id"])

    return run


for _how in (J.JoinType.INNER, J.JoinType.LEFT, J.JoinType.RIGHT, J.JoinType.FULL):
    for _alg in ("nl", "hash", "merge"):
        _kind = _how.value.upper() + (" OUTER" if _how is not J.JoinType.INNER else "")
        if _alg == "nl":
            _sql = f"SELECT s_suppkey, s_nationkey, n_nationkey, n_regionkey FROM supplier {_kind} JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 1"
        else:
            _sql = f"SELECT a_id, a_lang, b_id, b_quality FROM (SELECT doc_id AS a_id, lang AS a_lang FROM documents) a {_kind} JOIN (SELECT doc_id + 300 AS b_id, quality AS b_quality FROM labels) b ON a_id = b_id"
        query(_sql, f"join_{_how.value}_{_alg}")(_join(_alg, _how))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return J.nested_loop_join(t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name"), J.JoinType.CROSS)


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def join_hash_residual(spark, d):
    o, li = t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return J.hash_join(o, li, J.JoinType.LEFT, ["o_orderkey"], ["l_orderkey"], li.l_quantity > 45).select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT r_name, n_name, s_name FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey")
def cross_product_three(spark, d):
    p = R.cross_product(t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "supplier"))
    return p.filter("r_regionkey = n_regionkey AND n_nationkey = s_nationkey").select("r_name", "n_name", "s_name")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_alias(spark, d):
    a, b = R.derived(t(spark, d, "nation"), "a"), R.derived(t(spark, d, "nation"), "b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("""SELECT l.k AS lk, l.tag AS ltag, r.k AS rk, r.tag AS rtag FROM (VALUES (1,'a'),(2,'b'),(2,'c'),(NULL,'d')) AS l(k, tag)
FULL JOIN (VALUES (2,'x'),(3,'y'),(NULL,'z')) AS r(k, tag) ON l.k = r.k""")
def join_null_keys(spark, d):
    left = R.values(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d")], [("lk", DType.I32), ("ltag", DType.STRING)])
    right = R.values(spark, [(2, "x"), (3, "y"), (None, "z")], [("rk", DType.I32), ("rtag", DType.STRING)])
    return J.merge_join(left, right, J.JoinType.FULL, ["lk"], ["rk"])


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_using(spark, d):
    return J.join_using(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents) NATURAL JOIN (SELECT doc_id, quality FROM labels)")
def join_natural(spark, d):
    return J.natural_join(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels").select("doc_id", "quality"))


# sort, limit, grouping, derived tables


@query("SELECT k, v FROM (VALUES (1,1),(1,2),(2,1),(NULL,0)) AS x(k, v) ORDER BY k DESC NULLS LAST, v ASC NULLS LAST LIMIT 3")
def sort_multi(spark, d):
    v = R.values(spark, [(1, 1), (1, 2), (2, 1), (None, 0)], [("k", DType.I32), ("v", DType.I32)])
    return R.limit(R.sort(v, ("k", False), ("v", True)), 3)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10")
def limit_offset(spark, d):
    return R.limit(R.sort(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ("c_acctbal", False), ("c_custkey", True)), 20, 10)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(spark, d):
    return R.limit(R.sort(t(spark, d, "nation").select("n_nationkey", "n_name"), ("n_nationkey", True)), None, 20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk_orders(spark, d):
    return R.limit(R.sort(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", False), ("o_orderkey", True)), 25)


@query("SELECT q.o_orderkey, q.half FROM (SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus = 'P') AS q WHERE q.half > 200000")
def derived_table(spark, d):
    q = R.derived(t(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_totalprice") / 2).alias("half")), "q")
    return q.filter(F.col("q.half") > 200000).select("q.o_orderkey", "q.half")


@query("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment")
def group_no_agg(spark, d):
    return R.group_having(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment HAVING c_nationkey >= 10")
def group_having(spark, d):
    return R.group_having(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], F.col("c_nationkey") >= 10)


# DDL and DML: the final state of a fresh table


def _engine(spark) -> Engine:
    """An engine of a query's own, whose tables go when the driver ends."""
    root = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex[:12]}"
    atexit.register(_forget, spark, root)
    return Engine(spark, root)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            path, fs = hadoop(spark, root)
            fs.delete(path, True)
    except (Py4JError, OSError):  # the gateway may be gone as the driver ends
        pass


def _customers(spark, d) -> Engine:
    e = _engine(spark)
    e.register_parquet("customer", f"{d}/customer.parquet")
    e.sql("CREATE TABLE cust (id BIGINT PRIMARY KEY, nation INT NOT NULL, bal DOUBLE, seg STRING DEFAULT 'NONE')")
    e.sql("INSERT INTO cust SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    return e


_CUST = "SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS seg FROM customer"


@query("SELECT * FROM (VALUES (1, 'x', CAST(NULL AS BIGINT)), (2, 'y', NULL), (3, 'x', 7)) AS v(id, v, n)")
def insert_defaults(spark, d):
    e = _engine(spark)
    e.sql("CREATE TABLE ddl (id INT NOT NULL PRIMARY KEY, v STRING DEFAULT 'x', n BIGINT)")
    e.sql("INSERT INTO ddl (id) VALUES (1)")
    e.sql("INSERT INTO ddl (v, id) VALUES ('y', 2)")
    e.sql("INSERT INTO ddl (id, n) VALUES (3, 7)")
    return e.table("ddl")


@query(_CUST)
def insert_select(spark, d):
    return _customers(spark, d).table("cust")


@query(f"SELECT id, nation, CASE WHEN bal < 0 THEN bal + 100 ELSE bal END AS bal, CASE WHEN bal < 0 THEN 'DEBT' ELSE seg END AS seg FROM ({_CUST}) q")
def update_where(spark, d):
    e = _customers(spark, d)
    e.sql("UPDATE cust SET bal = bal + 100, seg = 'DEBT' WHERE bal < 0")
    return e.table("cust")


@query(f"SELECT id, nation + 1 AS nation, bal, seg FROM ({_CUST}) q")
def update_all(spark, d):
    e = _customers(spark, d)
    e.sql("UPDATE cust SET nation = nation + 1")
    return e.table("cust")


@query(f"SELECT * FROM ({_CUST}) q WHERE NOT (nation < 10)")
def delete_where(spark, d):
    e = _customers(spark, d)
    e.sql("DELETE FROM cust WHERE nation < 10")
    return e.table("cust")


@query("SELECT * FROM (VALUES (2, CAST(NULL AS INTEGER)), (3, 3)) AS v(id, v)")
def delete_null_pred(spark, d):
    e = _engine(spark)
    e.sql("CREATE TABLE nul (id INT, v INT)")
    e.sql("INSERT INTO nul VALUES (1, 1), (2, NULL), (3, 3)")
    e.sql("DELETE FROM nul WHERE v < 2")
    return e.table("nul")


@query("SELECT name FROM (VALUES ('kept'), ('sys_columns'), ('sys_indexes'), ('sys_tables')) AS v(name)")
def create_then_drop(spark, d):
    e = _engine(spark)
    e.sql("CREATE TABLE kept (id INT)")
    e.sql("CREATE TABLE gone (id INT)")
    e.sql("DROP TABLE gone")
    return e.table("sys_tables").select("name")


# visibility: four versions, made by transactions 10, 20 and 30; 25 is still active

_VERSIONS = [(1, 10, None, "a"), (2, 10, 20, "b"), (3, 20, None, "c"), (4, 30, None, "d")]
_VERSIONS_SQL = "(VALUES (1, 10, NULL, 'a'), (2, 10, 20, 'b'), (3, 20, NULL, 'c'), (4, 30, NULL, 'd')) AS v(id, xmin, xmax, v)"


def _versions(spark):
    return R.values(spark, _VERSIONS, [("id", DType.I32), ("_xmin", DType.I64), ("_xmax", DType.I64), ("v", DType.STRING)])


def _history():
    """10 and 20 commit, a reader begins, then 30 starts and stays open."""
    m = TxnManager(10)
    a = m.begin()
    m.commit(a)
    m._next = 15
    reader = m.begin(Isolation.SNAPSHOT)
    m._next = 20
    b = m.begin()
    m.commit(b)
    m._next = 30
    m.begin()
    return m, reader


@query(f"SELECT s.reader AS reader, id, v FROM {_VERSIONS_SQL} CROSS JOIN (VALUES (10), (15), (20), (25), (30)) AS s(reader) WHERE xmin <= s.reader AND (xmax IS NULL OR xmax > s.reader)")
def visible_as_of_each(spark, d):
    v = _versions(spark)
    return reduce(lambda a, b: a.unionByName(b), [v.filter(visible_as_of(at)).select(F.lit(at).alias("reader"), "id", "v") for at in (10, 15, 20, 25, 30)])


@query(f"SELECT id, v FROM {_VERSIONS_SQL} WHERE xmin = 10")
def visible_snapshot(spark, d):
    m, reader = _history()
    return _versions(spark).filter(m.visible(reader)).select("id", "v")


@query(f"SELECT id, v FROM {_VERSIONS_SQL} WHERE xmin IN (10, 20) AND xmax IS NULL")
def visible_read_committed(spark, d):
    m, reader = _history()
    reader.isolation = Isolation.READ_COMMITTED
    return _versions(spark).filter(m.visible(reader)).select("id", "v")


@query(f"SELECT id, v FROM {_VERSIONS_SQL} WHERE xmax IS NULL")
def visible_read_uncommitted(spark, d):
    m, reader = _history()
    reader.isolation = Isolation.READ_UNCOMMITTED
    return _versions(spark).filter(m.visible(reader)).select("id", "v")


# the same on stored tables: several transactions at once, and an index that is read by one of them


def _accounts(spark) -> Engine:
    e = _engine(spark)
    e.sql("CREATE TABLE acc (id BIGINT PRIMARY KEY, n INT)")
    e.sql("INSERT INTO acc VALUES (1, 10), (2, 20), (3, 30), (4, 40)")
    return e


def _conflict(f) -> None:
    try:
        f()
    except WriteConflict:
        return
    raise AssertionError("two transactions changed one row")


@query("SELECT * FROM (VALUES (1, 10), (3, 30), (4, 41)) AS v(id, n)")
def stored_first_writer_wins(spark, d):
    """An open transaction deletes a row that another then cannot delete or change; it commits one change and aborts another."""
    e = _accounts(spark)
    a, b = e.txns.begin(), e.txns.begin()
    e.sql("DELETE FROM acc WHERE id = 2", a)
    e.sql("DELETE FROM acc WHERE id = 1", b)
    _conflict(lambda: e.sql("DELETE FROM acc WHERE id <= 2"))
    _conflict(lambda: e.sql("UPDATE acc SET n = 0 WHERE id = 2", b))
    e.txns.commit(a)
    e.txns.abort(b)
    c = e.txns.begin()
    e.sql("UPDATE acc SET n = n + 1 WHERE id = 4")
    _conflict(lambda: e.sql("UPDATE acc SET n = n + 5 WHERE id = 4", c))
    e.txns.abort(c)
    return e.table("acc")


@query("""SELECT * FROM (VALUES ('snapshot', 1, 10), ('snapshot', 2, 20), ('snapshot', 3, 30), ('snapshot', 4, 40), ('committed', 2, 21), ('committed', 3, 30), ('committed', 4, 40),
('uncommitted', 2, 21), ('uncommitted', 4, 40), ('uncommitted', 5, 50), ('own', 2, 21), ('own', 4, 40), ('own', 5, 50)) AS v(reader, id, n)""")
def stored_isolation(spark, d):
    """A settled writer and an open one, as each kind of reader sees them; the last is the open writer itself."""
    e = _accounts(spark)
    readers = {"snapshot": e.txns.begin(Isolation.SNAPSHOT), "committed": e.txns.begin(Isolation.READ_COMMITTED), "uncommitted": e.txns.begin(Isolation.READ_UNCOMMITTED)}
    e.sql("DELETE FROM acc WHERE id = 1")
    e.sql("UPDATE acc SET n = n + 1 WHERE id = 2")
    readers["own"] = e.txns.begin()
    e.sql("DELETE FROM acc WHERE id = 3", readers["own"])
    e.sql("INSERT INTO acc VALUES (5, 50)", readers["own"])
    gone = e.txns.begin()
    e.sql("DELETE FROM acc WHERE id = 4", gone)
    e.txns.abort(gone)
    return reduce(DataFrame.unionByName, [e.table("acc", x).select(F.lit(name).alias("reader"), "id", "n") for name, x in readers.items()])


@query("SELECT * FROM (VALUES ('committed', 3, 30), ('committed', 7, 70), ('own', 3, 31), ('own', 7, 70), ('own', 8, 80)) AS v(reader, id, n)")
def stored_index_scan(spark, d):
    """A range of an index on a versioned table, as two readers see it; segments of before and after the index was made."""
    e = _accounts(spark)
    e.sql("CREATE INDEX acc_id ON acc (id)")
    e.sql("INSERT INTO acc VALUES (7, 70), (9, 90)")
    e.sql("DELETE FROM acc WHERE id = 4")
    own = e.txns.begin()
    e.sql("UPDATE acc SET n = n + 1 WHERE id = 3", own)
    e.sql("INSERT INTO acc VALUES (8, 80)", own)
    return reduce(DataFrame.unionByName, [e.index_scan("acc_id", 3, 9, x).select(F.lit(name).alias("reader"), "id", "n") for name, x in (("committed", None), ("own", own))])


@query("SELECT * FROM (VALUES (1, 11), (3, 30), (4, 40), (5, 5)) AS v(id, n)")
def stored_reopened(spark, d):
    """A second engine opens the table that a first one left, goes on with its ids and sees what was committed."""
    e = _accounts(spark)
    e.sql("DELETE FROM acc WHERE id = 2")
    e.sql("INSERT INTO acc VALUES (6, 60)", e.txns.begin())
    f = Engine(spark, e.root)
    f.txns.recover()
    f.sql("UPDATE acc SET n = n + 1 WHERE id = 1")
    f.sql("INSERT INTO acc VALUES (5, 5)")
    return e.table("acc")


@query("SELECT * FROM (VALUES (2, 20, 'row'), (1, NULL, 'TupleNotVisible'), (9, NULL, 'TupleNonExistent')) AS v(id, n, got)")
def stored_get(spark, d):
    e = _accounts(spark)
    at = {r.id: (r._seg, r._row) for r in e.tables.scan("acc", with_rid=True).collect()} | {9: (99, 0)}
    e.sql("DELETE FROM acc WHERE id = 1")
    rows = []
    for i in (2, 1, 9):
        try:
            rows.append((i, e.tables.get("acc", at[i])[1], "row"))
        except (TupleNotVisible, TupleNonExistent) as x:
            rows.append((i, None, type(x).__name__))
    return R.values(spark, rows, [("id", DType.I32), ("n", DType.I32), ("got", DType.STRING)])


@query("""SELECT * FROM (VALUES ('table', 'CatalogNotFound'), ('column', 'CatalogNotFound'), ('twice', 'DuplicateColumn'), ('exists', 'TableExists'), ('types', 'TypeMismatch'),
('reference', 'ColumnNotFound'), ('tag', 'InvalidTypeTag'), ('null', 'ConstraintViolation'), ('key', 'ConstraintViolation'), ('statement', 'UnsupportedStatement'), ('join', 'InvalidJoinCondition'), ('unique', 'NotUnique')) AS v(what, error)""")
def error_kinds(spark, d):
    e = _accounts(spark)
    n = t(spark, d, "nation")
    tries = {
        "table": lambda: e.table("no"), "column": lambda: e.sql("INSERT INTO acc (id, no) VALUES (9, 9)"), "twice": lambda: e.sql("CREATE TABLE two (id INT, id INT)"), "exists": lambda: e.sql("CREATE TABLE acc (id INT)"),
        "types": lambda: e.sql("SELECT id FROM acc WHERE id = '1'"), "null": lambda: e.sql("INSERT INTO acc (n) VALUES (1)"), "key": lambda: e.sql("INSERT INTO acc VALUES (1, 1)"), "statement": lambda: e.sql("MERGE INTO acc"),
        "reference": lambda: ref(n, "no"), "tag": lambda: DType.from_tag(12), "join": lambda: J.nested_loop_join(n, n, J.JoinType.INNER), "unique": lambda: R.index_get(n, "n_regionkey", 1),
    }
    rows = []
    for what, f in tries.items():
        try:
            f()
        except (CatalogNotFound, DuplicateColumn, TableExists, TypeMismatch, ConstraintViolation, UnsupportedStatement, ColumnNotFound, InvalidTypeTag, J.InvalidJoinCondition, R.NotUnique) as x:
            rows.append((what, type(x).__name__))
    return R.values(spark, rows, [("what", DType.STRING), ("error", DType.STRING)])


@query("SELECT k, v FROM (VALUES (1, 'a WHERE b'), (NULL, 'x'), (2, 'it''s ORDER BY')) AS t(k, v) ORDER BY k NULLS LAST LIMIT 2")
def text_nulls_last(spark, d):
    """SQL text keeps to the engine's NULL order, and quotes may hold any words."""
    e = _engine(spark)
    e.sql("CREATE TABLE w (k INT, v STRING DEFAULT 'it''s ORDER BY')")
    e.sql("INSERT INTO w (k) VALUES (1), (2)")
    e.sql("INSERT INTO w VALUES (NULL, 'x')")
    e.sql("UPDATE w SET v = 'a WHERE b' WHERE k = 1")
    return e.sql("SELECT k, v FROM w ORDER BY k LIMIT 2")


@query("""SELECT CAST(seq AS BIGINT) AS seq, op, CAST(id AS BIGINT) AS id, n FROM (VALUES (2, 'delete', 2, 20), (2, 'insert', 2, 21), (3, 'delete', 1, 10), (4, 'insert', 5, 50)) AS v(seq, op, id, n)""")
def change_feed(spark, d):
    """What was committed after the first commit, in the order of commits; the second transaction to begin is the last to commit."""
    e = _accounts(spark)
    late, gone, left = e.txns.begin(), e.txns.begin(), e.txns.begin()
    e.sql("INSERT INTO acc VALUES (5, 50)", late)
    e.sql("DELETE FROM acc WHERE id = 4", gone)
    e.txns.abort(gone)
    e.sql("DELETE FROM acc WHERE id = 3", left)
    e.sql("UPDATE acc SET n = n + 1 WHERE id = 2")
    e.sql("DELETE FROM acc WHERE id = 1")
    e.txns.commit(late)
    return changes(e, "acc", commits(e, 1)).select("seq", "op", "id", "n")


# catalog


@query("""SELECT * FROM (VALUES ('oid 0', 'sys_tables'), ('oid 1', 'sys_columns'), ('oid 2', 'sys_indexes'), ('table', 'orders'), ('table of the index', 'orders'),
('key of the index', 'o_orderkey'), ('index', 'orders_key'), ('dropped', 'CatalogNotFound'), ('its index', 'CatalogNotFound')) AS v(what, name)""")
def catalog_lookups(spark, d):
    """By name and by object id, by a second engine too; what is dropped goes with its indexes."""
    e = _engine(spark)
    e.register_parquet("orders", f"{d}/orders.parquet")
    made, own = e.catalog.table("orders"), e.catalog.add_index("orders_key", "orders", "o_orderkey")
    f = Engine(spark, e.root).catalog
    rows = [(f"oid {i}", f.table_by_oid(i).name) for i in range(3)] + [("table", f.table_by_oid(made.oid).name), ("table of the index", f.table_by_oid(f.index("orders_key").table_oid).name)]
    rows += [("key of the index", f.key_of(f.index_by_oid(own.oid))), ("index", f.index_by_oid(own.oid).name)]
    e.catalog.drop_table("orders")
    f.refresh()
    for what, g in (("dropped", lambda: f.table("orders")), ("its index", lambda: f.index_by_oid(own.oid))):
        try:
            rows.append((what, str(g())))
        except CatalogNotFound as x:
            rows.append((what, type(x).__name__))
    return R.values(spark, rows, [("what", DType.STRING), ("name", DType.STRING)])


@query("SELECT CAST(oid AS BIGINT) AS oid, name, CAST(file_id AS BIGINT) AS file_id FROM (VALUES (0, 'sys_tables', 0), (1, 'sys_columns', 1), (2, 'sys_indexes', 2)) AS v(oid, name, file_id)")
def sys_tables(spark, d):
    return _engine(spark).table("sys_tables")


@query("""SELECT CAST(oid AS BIGINT) AS oid, CAST(table_oid AS BIGINT) AS table_oid, name, CAST(type_id AS SMALLINT) AS type_id, position, nullable FROM (VALUES
(0,0,'oid',7,0,false),(1,0,'name',11,1,false),(2,0,'file_id',7,2,false),(10,1,'oid',7,0,false),(11,1,'table_oid',7,1,false),(12,1,'name',11,2,false),
(13,1,'type_id',5,3,false),(14,1,'position',6,4,false),(15,1,'nullable',0,5,false),(20,2,'oid',7,0,false),(21,2,'name',11,1,false),(22,2,'table_oid',7,2,false),
(23,2,'column_oid',7,3,false)) AS v(oid, table_oid, name, type_id, position, nullable)""")
def sys_columns(spark, d):
    return _engine(spark).table("sys_columns")


@query("SELECT 'orders_key' AS name, 'orders' AS table_name, 'o_orderkey' AS column_name")
def sys_indexes(spark, d):
    e = _engine(spark)
    e.register_parquet("orders", f"{d}/orders.parquet")
    e.catalog.add_index("orders_key", "orders", "o_orderkey")
    i, tb, c = e.table("sys_indexes"), e.table("sys_tables"), e.table("sys_columns")
    return i.join(tb, i.table_oid == tb.oid).join(c, i.column_oid == c.oid).select(i.name, tb.name.alias("table_name"), c.name.alias("column_name"))


@query("""SELECT * FROM (VALUES ('sys_tables', 'oid', 20), ('sys_tables', 'name', 24), ('sys_tables', 'file_id', 28), ('sys_columns', 'oid', 20), ('sys_columns', 'table_oid', 24),
('sys_columns', 'name', 28), ('sys_columns', 'type_id', 32), ('sys_columns', 'position', 34), ('sys_columns', 'nullable', 36), ('sys_indexes', 'oid', 20),
('sys_indexes', 'name', 24), ('sys_indexes', 'table_oid', 28), ('sys_indexes', 'column_oid', 32)) AS v(table_name, column_name, starts)""")
def tuple_layout(spark, d):
    e = _engine(spark)
    rows = [(n, c, at) for n in ("sys_tables", "sys_columns", "sys_indexes") for c, at in e.catalog.layout(n).offsets.items()]
    return R.values(spark, rows, [("table_name", DType.STRING), ("column_name", DType.STRING), ("starts", DType.I32)])
