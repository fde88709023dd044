import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stonefly.llm import bpe


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, texts):
    mine, theirs = both
    got = list(mine.encode_texts(texts))
    assert got == [theirs.encode_ordinary(t or "") for t in texts]
    assert [mine.decode(ids) for ids in got] == [(t or "").encode() for t in texts]


def test_edges(both):
    same(both, [None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3000 + " " * 700, "<|endoftext|>", "don't I'LL", "\x1c\x1d a", "né́ 日本語 😀👍🏽", "x" * 64, "x" * 65, "é" * 33, "　\xa0 1²³4"])


def test_each_character(both):
    """Every code point alone beside a letter, a digit, a sign: the classes agree with the library's."""
    for a in "a1!":
        texts = ["".join(a + chr(c) + "\n" for c in range(s, min(s + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for s in range(0, 0x110000, 4096)]
        same(both, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(both, texts):
    same(both, texts)


def test_trees_agree(both):
    r = random.Random(5)
    pieces = ["".join(r.choice("abehtin sdrò") for _ in range(r.randint(2, 40))).encode() for _ in range(400)]
    for p in pieces:
        if p not in both[0].ranks and len(p) <= 64:
            assert both[0].merge_short([p], max(2, 1 << (len(p) - 1).bit_length()))[0] == both[0].merge_long(p)


def test_small_cache(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "CHUNK", 20)
    same(both, [f"alpha beta{i} gamma alpha" for i in range(40)])


def test_frames(spark, both):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, "é", None), (3, None, "y"), (4, "", "z"), (5, "word " * 60_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    enc = bpe.encode(docs)
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(x.bytes)) for r, x in zip(enc.collect(), bpe.decode(enc).collect(), strict=True))
    assert [g[2] for g in got] == [b"\xc3\xa9", b"hello world", b"hello world", b"", b"", b"word " * 60_000]
    d = {r.doc_id: r for r in bpe.digests(docs).collect()}
    ids = both[1].encode_ordinary("hello world")
    assert d[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and d[1].n_tokens == len(ids)
    assert d[3].decoded_sha256 == d[4].decoded_sha256 == hashlib.sha256(b"").hexdigest() and d[3].n_tokens == 0
    assert bpe.digests(docs.limit(0)).collect() == []
