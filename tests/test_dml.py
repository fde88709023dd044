import uuid

import pytest

from stonefly.plans.dml import CommitConflict, ConstraintViolation, Store
from stonefly.plans.txn import Isolation, TupleNonExistent, TupleNotVisible, WriteConflict
from stonefly.session import Engine, UnsupportedStatement, shared_folder, split_top
from stonefly.sources.catalog import CatalogNotFound, DuplicateColumn, TableExists


@pytest.fixture
def engine(spark):
    e = Engine(spark, f"{shared_folder(spark)}/t/{uuid.uuid4().hex}")
    e.sql("CREATE TABLE acc (id BIGINT PRIMARY KEY, owner STRING NOT NULL, n INT DEFAULT 5, small UTINYINT)")
    e.sql("INSERT INTO acc (id, owner) VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    return e


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lifecycle(engine):
    engine.sql("UPDATE acc SET n = n * 2, owner = concat(owner, '!') WHERE id >= 2")
    engine.sql("DELETE FROM acc WHERE id = 3")
    assert rows(engine.table("acc")) == [(1, "a", 5, None), (2, "b!", 10, None)]
    engine.sql("DELETE FROM acc")
    assert rows(engine.table("acc")) == []
    engine.sql("DROP TABLE acc")
    with pytest.raises(CatalogNotFound):
        engine.table("acc")


def test_constraints_leave_no_trace(engine):
    before = rows(engine.table("acc"))
    for bad in ("INSERT INTO acc (id, owner) VALUES (4, NULL)", "INSERT INTO acc (id, owner) VALUES (1, 'z')", "INSERT INTO acc (id, owner) VALUES (8, 'y'), (8, 'z')", "INSERT INTO acc (owner) VALUES ('q')", "UPDATE acc SET id = 1"):
        with pytest.raises(ConstraintViolation):
            engine.sql(bad)
        assert rows(engine.table("acc")) == before
    with pytest.raises(Exception, match="out of range"):
        engine.sql("INSERT INTO acc (id, owner, small) VALUES (9, 'y', 256)")
    engine.sql("UPDATE acc SET id = id + 1")
    assert [r[0] for r in rows(engine.table("acc"))] == [2, 3, 4]


def test_isolation(engine):
    snap = engine.txns.begin(Isolation.SNAPSHOT)
    rc, ru = engine.txns.begin(Isolation.READ_COMMITTED), engine.txns.begin(Isolation.READ_UNCOMMITTED)
    writer = engine.txns.begin()
    engine.sql("DELETE FROM acc WHERE id = 1", writer)
    engine.sql("INSERT INTO acc (id, owner) VALUES (4, 'd')", writer)
    ids = lambda t: [r[0] for r in rows(engine.table("acc", t))]
    assert (ids(snap), ids(rc), ids(ru), ids(writer)) == ([1, 2, 3], [1, 2, 3], [2, 3, 4], [2, 3, 4])
    engine.txns.commit(writer)
    assert (ids(snap), ids(rc), ids(None)) == ([1, 2, 3], [2, 3, 4], [2, 3, 4])


def test_abort(engine):
    t = engine.txns.begin()
    engine.sql("DELETE FROM acc", t)
    engine.txns.abort(t)
    assert len(rows(engine.table("acc"))) == 3
    engine.sql("DELETE FROM acc WHERE id = 2")
    assert [r[0] for r in rows(engine.table("acc"))] == [1, 3]
    with pytest.raises(ValueError):
        engine.txns.commit(t)


def test_point_get(engine):
    rid = engine.tables.scan("acc", with_rid=True).filter("id = 2").select("_seg", "_row").first()
    assert engine.tables.get("acc", tuple(rid))[0] == 2
    engine.sql("DELETE FROM acc WHERE id = 2")
    with pytest.raises(TupleNotVisible):
        engine.tables.get("acc", tuple(rid))
    with pytest.raises(TupleNonExistent):
        engine.tables.get("acc", (99, 0))


def test_catalog(engine):
    c = engine.catalog
    oid = c.table("acc").oid
    assert c.table_by_oid(oid).name == "acc" and c.add_index("ix", "acc", "n").table_oid == oid
    assert c.index("ix") == c.index_by_oid(c.index("ix").oid)
    for f in (lambda: c.table("no"), lambda: c.table_by_oid(9999), lambda: c.index("no"), lambda: c.index_by_oid(1), lambda: c.add_index("iy", "acc", "no")):
        with pytest.raises(CatalogNotFound):
            f()
    with pytest.raises(TableExists):
        engine.sql("CREATE TABLE acc (id INT)")
    with pytest.raises(DuplicateColumn):
        engine.sql("CREATE TABLE two (id INT, id INT)")
    assert rows(engine.sql("SELECT owner, n FROM acc WHERE id = 1")) == [("a", 5)]
    for bad in ("MERGE INTO acc", "", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(UnsupportedStatement):
            engine.sql(bad)
    assert split_top("a = 'x,y', b = f(1, 2)") == ["a = 'x,y'", "b = f(1, 2)"]


def test_change_feed(engine, spark):
    """Commits in their order, deletes too; nothing of transactions that aborted, failed or are open; the checkpoint goes on."""
    from stonefly.streaming import follow

    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    got = []
    run = lambda: follow(engine, "acc", lambda df, n: got.extend((r.seq, r.op, r.id, r.n) for r in df.collect()), path).awaitTermination(60)
    assert run()
    assert sorted(got) == [(1, "insert", i, 5) for i in (1, 2, 3)]
    got.clear()
    late, gone = engine.txns.begin(), engine.txns.begin()
    engine.sql("INSERT INTO acc (id, owner) VALUES (8, 'l')", late)
    engine.sql("DELETE FROM acc WHERE id = 1", gone)
    engine.txns.abort(gone)
    with pytest.raises(ConstraintViolation):
        engine.sql("INSERT INTO acc (id, owner) VALUES (2, 'z')")
    engine.sql("UPDATE acc SET n = 6 WHERE id = 2")
    assert run()
    assert sorted(got) == [(2, "delete", 2, 5), (2, "insert", 2, 6)]
    engine.txns.commit(late)
    got.clear()
    assert run()
    assert got == [(3, "insert", 8, 5)]


def test_two_writers_of_a_row(engine):
    """The first wins; a delete or update that committed is never undone by one that was open before it."""
    t1, t2 = engine.txns.begin(), engine.txns.begin()
    engine.sql("DELETE FROM acc WHERE id = 1", t1)
    engine.sql("UPDATE acc SET n = 30 WHERE id = 2", t2)
    for text in ("DELETE FROM acc WHERE id = 1", "UPDATE acc SET n = 40 WHERE id = 2", "DELETE FROM acc"):
        with pytest.raises(WriteConflict):
            engine.sql(text)
    engine.txns.commit(t2)
    engine.txns.abort(t1)
    engine.sql("DELETE FROM acc WHERE id = 1")
    assert [r[0::2] for r in rows(engine.table("acc"))] == [(2, 30), (3, 5)]
    # a snapshot that began before a commit cannot change what that changed
    old = engine.txns.begin(Isolation.SNAPSHOT)
    engine.sql("UPDATE acc SET n = 31 WHERE id = 2")
    with pytest.raises(WriteConflict):
        engine.sql("UPDATE acc SET n = 32 WHERE id = 2", old)
    assert [r[0::2] for r in rows(engine.table("acc"))] == [(2, 31), (3, 5)]
    # two open transactions cannot both insert a key; once the first aborts the second can
    a, b = engine.txns.begin(), engine.txns.begin()
    engine.sql("INSERT INTO acc (id, owner) VALUES (9, 'a')", a)
    with pytest.raises(ConstraintViolation):
        engine.sql("INSERT INTO acc (id, owner) VALUES (9, 'b')", b)
    engine.txns.abort(a)
    engine.sql("INSERT INTO acc (id, owner) VALUES (9, 'b')", b)
    engine.txns.commit(b)
    assert rows(engine.table("acc"))[-1][:2] == (9, "b")


def test_a_commit_between(engine, monkeypatch):
    """A version published while a statement runs: the statement is checked against it and published after it."""
    from stonefly.plans import dml

    commit, once = dml.Store.commit, []

    def between(store, m):
        if not once:
            once.append(1)
            engine.sql("INSERT INTO acc (id, owner) VALUES (50, 'between')")
        commit(store, m)

    monkeypatch.setattr(dml.Store, "commit", between)
    engine.sql("INSERT INTO acc (id, owner) VALUES (51, 'late')")
    assert [r[0] for r in rows(engine.table("acc"))] == [1, 2, 3, 50, 51]
    once.clear()
    with pytest.raises(ConstraintViolation):
        monkeypatch.setattr(dml.Store, "commit", lambda s, m: (once.append(1), engine.sql("INSERT INTO acc (id, owner) VALUES (60, 'first')")) and commit(s, m) if not once else commit(s, m))
        engine.sql("INSERT INTO acc (id, owner) VALUES (60, 'second')")
    assert rows(engine.table("acc"))[-1][:2] == (60, "first")


def test_reopening(engine, spark):
    engine.sql("CREATE INDEX acc_n ON acc (n)")
    engine.sql("DELETE FROM acc WHERE id = 1")
    left = engine.txns.begin()
    engine.sql("DELETE FROM acc WHERE id = 2", left)
    other = Engine(spark, engine.root)
    assert rows(other.table("acc")) == rows(engine.table("acc")) and other.catalog.table("acc") == engine.catalog.table("acc")
    assert other.catalog.index("acc_n").table_oid == other.catalog.table("acc").oid
    with pytest.raises(WriteConflict):
        other.sql("DELETE FROM acc WHERE id = 2")
    t = other.txns.begin()
    assert t.id == left.id + 2  # the failed statement had one
    other.txns.abort(t)
    assert other.txns.recover() == [left.id]
    other.sql("DELETE FROM acc WHERE id = 2")
    assert [r[0] for r in rows(engine.table("acc"))] == [3]
    with pytest.raises(ValueError):
        engine.txns.commit(left)
    # names and ids of both sessions do not meet
    other.sql("CREATE TABLE b (id INT)")
    engine.sql("CREATE TABLE c (id INT)")
    assert engine.catalog.table("b").oid != engine.catalog.table("c").oid == other.catalog.table("c").oid
    with pytest.raises(TableExists):
        engine.sql("CREATE TABLE b (id INT)")


def test_indexes(engine, spark):
    from stonefly.operators.relational import NotUnique
    from stonefly.sources import index

    d = "/root/testdata/sf0.001/orders.parquet"
    engine.register_parquet("orders", d)
    engine.create_index("by_key", "orders", "o_orderkey", files=6)
    engine.create_index("by_status", "orders", "o_orderstatus", files=7)
    every = spark.read.parquet(d)
    assert rows(engine.index_scan("by_key", 100, 300)) == rows(every.filter("o_orderkey >= 100 AND o_orderkey < 300"))
    assert rows(engine.index_scan("by_key")) == rows(every) and rows(engine.index_scan("by_key", 10**9)) == []
    assert rows(engine.index_get("by_key", 7)) == rows(every.filter("o_orderkey = 7")) and rows(engine.index_get("by_key", -1)) == []
    with pytest.raises(NotUnique):
        engine.index_get("by_status", "F")
    path = engine.catalog.index("by_key").path
    assert len(index.files(spark, path, "o_orderkey", 100, 110)) == 1 < len(index.files(spark, path, "o_orderkey")) == 6
    assert len(engine.index_scan("by_key", 100, 110).inputFiles()) == 1
    # a common key is split over several files
    assert len(index.files(spark, engine.catalog.index("by_status").path, "o_orderstatus", "F", "F", closed=True)) > 1
    # more files than the driver keeps
    index._kept.cache_clear()
    kept, index.KEPT = index.KEPT, 2
    try:
        assert rows(engine.index_scan("by_key", 100, 300)) == rows(every.filter("o_orderkey >= 100 AND o_orderkey < 300"))
    finally:
        index.KEPT = kept
        index._kept.cache_clear()
    engine.sql("CREATE INDEX acc_id ON acc (id)")
    engine.sql("INSERT INTO acc (id, owner) VALUES (10, 'x'), (11, 'y')")
    engine.sql("DELETE FROM acc WHERE id = 2")
    assert [r[0] for r in rows(engine.index_scan("acc_id", 2, 11))] == [3, 10] and sum("/data-" in f for f in engine.index_scan("acc_id", 10).inputFiles()) == 1
    Store(spark, engine.catalog.table("acc").path).vacuum()
    assert [r[0] for r in rows(engine.index_scan("acc_id", 2, 11))] == [3, 10]
    with pytest.raises(CatalogNotFound):
        engine.sql("CREATE INDEX no ON acc (no)")


def test_text(engine):
    from stonefly.functions.expr import TypeMismatch
    from stonefly.session import nulls_last, split_word

    assert split_word("SET a = 'x WHERE y' WHERE b = f(WHERE)", "WHERE") == ("SET a = 'x WHERE y'", "b = f(WHERE)")
    assert nulls_last("SELECT a FROM t ORDER BY a, b DESC NULLS FIRST LIMIT 3") == "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST LIMIT 3"
    assert nulls_last("SELECT sum(a) OVER (PARTITION BY b ORDER BY f(a, c) ROWS 1 PRECEDING) FROM (SELECT 'ORDER BY x' ORDER BY 1)") == "SELECT sum(a) OVER (PARTITION BY b ORDER BY f(a, c) NULLS LAST ROWS 1 PRECEDING) FROM (SELECT 'ORDER BY x' ORDER BY 1 NULLS LAST)"
    engine.sql("CREATE TABLE w (k INT, s STRING DEFAULT 'a NOT NULL, b')")
    engine.sql("INSERT INTO w (k) VALUES (2), (NULL), (1)")
    engine.sql("UPDATE w SET s = 'a WHERE b' WHERE k = 1")
    assert [tuple(r) for r in engine.sql("SELECT k, s FROM w ORDER BY k").collect()] == [(1, "a WHERE b"), (2, "a NOT NULL, b"), (None, "a NOT NULL, b")]
    for text in ("SELECT * FROM w WHERE k = '1'", "SELECT k + s FROM w", "SELECT * FROM w a JOIN w b ON a.k = b.s"):
        with pytest.raises(TypeMismatch):
            engine.sql(text)
    assert engine.sql("SELECT * FROM w WHERE k = CAST('1' AS INT)").count() == 1
    # dates pass through as Spark has them
    engine.register_parquet("orders", "/root/testdata/sf0.001/orders.parquet")
    assert 0 < engine.sql("SELECT o_orderkey FROM orders WHERE o_orderdate < '1997-01-01' AND o_totalprice > 5").count() < 1500
    for bad in ("UPDATE w SET", "UPDATE w SET k", "UPDATE w SET k = 1 WHERE", "CREATE TABLE x (k INT WHAT)"):
        with pytest.raises(UnsupportedStatement):
            engine.sql(bad)


def test_publishing(engine, spark):
    """A version is published once; a draft that a lost driver left does no harm; vacuum keeps what is in use."""
    path = engine.catalog.table("acc").path
    store = Store(spark, path)
    now = store.read_manifest()
    with pytest.raises(CommitConflict):
        store.commit(now)
    store._fs.create(store._path(f"{path}/_draft-left"), True).close()
    engine.sql("DELETE FROM acc WHERE id = 1")
    want = rows(engine.table("acc"))
    assert store.read_manifest()["version"] == now["version"] + 1
    store.vacuum()
    assert rows(engine.table("acc")) == want and len(store._manifests()) == 1
    engine.sql("INSERT INTO acc (id, owner) VALUES (7, 'g')")
    assert len(rows(engine.table("acc"))) == len(want) + 1
