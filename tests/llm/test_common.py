import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stonefly.llm import common


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=400)), max_size=60), st.integers(1, 3000))
def test_slices(texts, most):
    """All rows in order; no slice of several rows holds much more than the bound; a long row is alone in its slice."""
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    out = list(common.slices(iter([b]), most))
    assert pa.Table.from_batches(out, b.schema).to_pydict() == b.to_pydict()
    if b.nbytes > most:
        for s in out:
            assert s.num_rows == 1 or sum(len((t or "").encode()) for t in s.column("text").to_pylist()) <= most


def test_map_batches_takes_arrays(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 50)
    df = spark.createDataFrame([(i, "é" * i, i) for i in range(40)], "id bigint, text string, other int").repartition(3)
    out = common.map_batches(df.select("id", "text"), lambda c: {"n": pa.array([len(t) for t in c["text"]], pa.int64()), "id": c["id"]}, "id bigint, n bigint")
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(40)]
    assert common.map_batches(df.limit(0).select("id", "text"), lambda c: {"n": [], "id": []}, "id bigint, n bigint").collect() == []
