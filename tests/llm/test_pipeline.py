import re
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from stonefly.llm import bpe, mixing, quality, secrets
from tests.llm.test_simhash import classes, plain

D = "/root/testdata/sf0.001"


def test_names():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.score >= quality.THRESHOLD}
    rows = [r.asDict() for r in docs.collect() if r.doc_id in good]
    of = classes({r["doc_id"]: plain(r["text"]) for r in rows})
    rows = [r for r in rows if of[r["doc_id"]] == r["doc_id"]]
    assert 0 < len(rows) < docs.count()
    for r in rows:
        b = r["text"].encode()
        text = secrets.redact_text(b).decode()
        assert (text == r["text"]) == (not secrets.scan(b)[1])
        r["text"] = text
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    copies = {d: c for d, c in con.sql(mixing.SQL).select("doc_id", "copies").fetchall()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    want = Counter()
    for r in rows:
        want[r["doc_id"], tuple(enc.encode_ordinary(r["text"]))] += copies[r["doc_id"]]
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, D).collect())
    assert got == +want


def test_stages_keep_columns_and_take_anything(spark):
    """Each stage on nulls, empty texts, repeats, further columns and no rows."""
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, None, None, "y"), (None, "some words of text here " * 5, "en", "a", 5, None), (4, "token=abcdefgh1 " * 3, "de", "b", 48, "z"), (4, "token=abcdefgh1 " * 3, "de", "b", 48, "z"), (6, "other words " * 20_000, "fr", "a", 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, D)
            assert name.startswith("byte-level") or out.columns == docs.columns
            n = out.count()
            assert n if df is docs else not n
