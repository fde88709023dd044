import random

import pytest
import xxhash

from stonefly.llm import simhash
from stonefly.llm.common import Scratch


def plain(text, shingle=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(prints, bits=2):
    """Least id reachable, by comparing all pairs of distinct values."""
    values = sorted(set(prints.values()))
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                up[top(b)] = top(a)
    least = {}
    for d, v in prints.items():
        least[top(v)] = min(d, least.get(top(v), d))
    return {d: least[top(v)] for d, v in prints.items()}


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "É é A a x Y Z", "w " * 400, "\x1c x\x0by\x0cz q", "日本 語 です ね"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


def linked(spark, values):
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint").repartition(3)
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.link_fingerprints(df, Scratch(spark)).collect()}
    out = {}
    for v in values:
        out.setdefault(got.get(v, v), set()).add(v)
    return {frozenset(s) for s in out.values()}


def truth(values):
    groups = {}
    for v, c in classes({v: v for v in values}).items():
        groups.setdefault(c, set()).add(v)
    return {frozenset(s) for s in groups.values()}


def test_links(spark):
    r = random.Random(3)
    values = set()
    for _ in range(60):
        v = r.getrandbits(64)
        for _ in range(r.randint(1, 4)):
            values.add(v)
            for _ in range(r.randint(1, 3)):
                v ^= 1 << r.randrange(64)
    values |= {0, 1, 3, 7, 2**64 - 1, 2**63, 2**63 | 1 << 31}
    assert linked(spark, sorted(values)) == truth(values)


def test_crowded_half(spark):
    """Hundreds of fingerprints that share a half are cut again and lose no link."""
    r = random.Random(4)
    a = r.getrandbits(32)
    values = {a << 32 | r.getrandbits(9) << 20 | r.getrandbits(3) for _ in range(400)} | {r.getrandbits(10) << 40 | a for _ in range(200)} | {(a ^ 1 << r.randrange(32)) << 32 | r.getrandbits(10) for _ in range(200)}
    assert linked(spark, sorted(values)) == truth(values)


def test_frames(spark):
    rows = [(5, "a b c d e f", "x"), (3, "A b c d e f", None), (3, "A b c d e f", None), (9, None, "y"), (8, "", "y"), (7, " ", "y"), (None, "a b c d e f", "z"), (None, None, "z"), (11, "long " * 50_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    one = f"{plain('a b c d e f'):016x}"
    assert by[5, one] == by[3, one] == by[None, one] == 3
    assert {by[d, "0" * 16] for d in (9, 8, 7, None)} == {7}
    assert by[11, f"{plain('long ' * 50_000):016x}"] == 11
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_keep_first(spark):
    rows = [
        (5, "a b c d e f", "x"), (3, "A b c d e f", "y"), (3, "A b c d e f", "y"), (3, "a B c d e f", "z"), (3, "some other words altogether here", "w"), (None, "a b c d e F", "v"),
        (4, "quite another text of words", None), (None, "no id and no copy at all", "u"), (None, "no id and no copy at all", "u"), (8, None, "t"), (9, "", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, th string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=repr)
    # of document 3, rows that share its component leave one; its other text is a component of its own
    one = [r for r in got if r[0] == 3 and r[1] != rows[4][1]]
    assert len(one) == 1 and one[0] in rows
    assert got == sorted([*one, rows[4], rows[6], rows[7], rows[8], rows[9]], key=repr)
    assert simhash.keep_first(docs.limit(0)).collect() == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = classes({r.doc_id: plain(r.text) for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
