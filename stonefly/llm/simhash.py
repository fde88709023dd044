"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Of two fingerprints that
differ in at most two bits either one half is equal, or each half differs in
exactly one bit. So 34 keys suffice: each half as it is, and the first half
with each of its bits masked in turn. Fingerprints that share a key are
compared in full.

Only distinct fingerprints are indexed, so copies, however many, are one entry.
A key that still holds more than ``SMALL`` fingerprints is cut again: the part
that it leaves open is segmented in the same way, after which a group shares 47
bits at least and so cannot exceed 2^17 distinct fingerprints whatever the
corpus. Groups send on a star for each of their components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonefly.llm.common import Scratch, map_batches
from stonefly.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 2
#: Groups up to this size are compared pair by pair; larger ones are cut again.
SMALL = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text as an unsigned integer; null, empty and blank texts have 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n < 1:
        return digest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens)[:n].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
            counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (bigint with the bits of the fingerprint), ``th`` (a hash of the text as it is)."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    return map_batches(own, lambda c: {"doc_id": c["doc_id"], "fp": [_signed(fingerprint(t)) for t in c["text"]], "th": c["th"]}, f"doc_id {kind}, fp bigint, th bigint")


def _keys(value: Column, width: int, base: int, masked: bool) -> list[Column]:
    """Keys of one segment: as it is, or with each bit masked; ``base`` numbers the kinds."""
    if not masked:
        return [value + F.lit(base << 48)]
    return [value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))) + F.lit((base + i) << 48) for i in range(width)]


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _variants(fps: DataFrame) -> DataFrame:
    a, b = _halves(F.col("fp"))
    return fps.select("fp", F.explode(F.array(*_keys(a, 32, 0, False), *_keys(b, 32, 1, False), *_keys(a, 32, 2, True))).alias("key"))


def _refined(hot: DataFrame) -> DataFrame:
    """Keys for members of large groups. Kind 0 or 1: the other half differs in up to two bits, so it is
    segmented like a whole fingerprint. A masked kind: it differs in one bit, so one of its quarters is equal."""
    kind = F.shiftright("key", 48)
    a, b = _halves(F.col("fp"))
    rest = F.when(kind == 0, b).otherwise(F.when(kind == 1, a).otherwise(b))
    high, low = F.shiftrightunsigned(rest, 16), rest.bitwiseAND(F.lit(0xFFFF))
    plain = [*_keys(high, 16, 0, False), *_keys(low, 16, 1, False)]
    sub = F.when(kind < 2, F.array(*plain, *_keys(high, 16, 2, True))).otherwise(F.array(*plain))
    return hot.select("key", F.explode(sub).alias("sub"), "fp")


_BIT = np.uint64(1)


def _links(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows in equal groups (sorted by group) whose fingerprints differ in at most ``bits`` bits."""
    edges_a, edges_b = [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= SMALL, sizes)
    longest = int(sizes[sizes <= SMALL].max(initial=1))
    for step in range(1, longest):
        i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        if len(i):
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
            edges_a.append(i)
            edges_b.append(i + step)
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = fp[s : s + n]
        order = np.argsort(own)
        ranked = own[order]
        varying = int(np.bitwise_or.reduce(own ^ own[0]))
        places = [i for i in range(64) if varying >> i & 1]
        for k in range(1, bits + 1):
            for c in combinations(places, k):
                want = ranked ^ np.uint64(sum(1 << i for i in c))
                at = np.minimum(np.searchsorted(ranked, want), n - 1)
                hit = np.flatnonzero((ranked[at] == want) & (want > ranked))
                edges_a.append(s + order[hit])
                edges_b.append(s + order[at[hit]])
    if not edges_a:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(edges_a), np.concatenate(edges_b)


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as one star for each component of this batch: nodes and their least member."""
    nodes, inverse = np.unique(fp, return_inverse=True)
    x, y = inverse[a], inverse[b]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _scan(bits: int):
    """Over batches sorted by (key, sub): whole groups are linked, an open one waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(key, sub, fp):
            turn = np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]
            a, b = _stars(fp, *_links(np.cumsum(turn), fp.view(np.uint64), bits))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, sub, fp = now if rest is None else [np.concatenate(p) for p in zip(rest, now, strict=True)]
            if not len(key):
                continue
            cut = int(np.flatnonzero((key != key[-1]) | (sub != sub[-1])).max(initial=-1)) + 1
            if cut:
                yield out(key[:cut], sub[:cut], fp[:cut])
            rest = (key[cut:], sub[cut:], fp[cut:])
        if rest is not None and len(rest[0]) > 1:
            yield out(*rest)

    return run


def link_fingerprints(fps: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """fps: one column ``fp`` of distinct values. Returns ``node``, ``root`` as ``components`` does."""
    if bits > 2:
        raise ValueError("two halves with one masked bit prove up to two differing bits")
    variants = _variants(fps)
    shared = scratch.cut(variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = scratch.cut(variants.join(shared, "key"))
    cold = members.filter(F.col("n") <= SMALL).select("key", F.lit(0).cast("bigint").alias("sub"), "fp")
    rows = cold.unionByName(_refined(members.filter(F.col("n") > SMALL)))
    edges = rows.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_scan(bits), "a bigint, b bigint")
    return components(edges, scratch)


def components_of(prints: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """prints: ``doc_id``, ``fp``, on storage. Adds ``component_id``, the least doc_id reachable over links, and ``root``, a fingerprint of the component.

    Null ids count as no id: a component of such rows alone has a null component_id. Repeated rows stay repeated.
    """
    fps = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = link_fingerprints(fps.select("fp"), scratch, bits)
    placed = scratch.cut(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")))
    best = scratch.cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")).filter("k > 1"))
    # fingerprints of one document that link to none need no entry
    known = placed.filter("copies > 1 or linked").join(best, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "root")
    heads = best.select(F.col("root").alias("fp"), "component_id", "root")
    known = scratch.cut(known.join(heads.select("fp"), "fp", "left_anti").unionByName(heads))
    scratch.drop(fps, placed, best)
    return prints.join(known, "fp", "left").select(*prints.columns, F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other; null ids as in
    ``components_of``; repeated rows are returned as often; further columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.cut(fingerprints(docs, id_col, text_col).drop("th"))
    out = components_of(prints, scratch, bits)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents that lead their component, with all their columns: the row of least doc_id, and of rows that share
    it the one of least text hash; exact repeats of its id and text go as well.

    A row without an id goes if its component has one with an id; components of such rows alone stay, as do their
    repeats. Texts are exchanged only where the rows that go are too many to broadcast.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.cut(fingerprints(docs))
    placed = scratch.cut(components_of(prints, scratch, bits).select("doc_id", "th", "component_id", "root"))
    lead = F.col("doc_id").eqNullSafe(F.col("component_id"))
    leads = placed.filter(lead & F.col("doc_id").isNotNull())
    shared = scratch.cut(leads.groupBy(F.col("root").alias("of"), F.col("doc_id").alias("id")).agg(F.min("th").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    second = leads.join(shared, (F.col("root") == F.col("of")) & (F.col("th") > F.col("first")))
    follow = placed.filter(~lead).unionByName(second.select(*placed.columns))
    gone = scratch.cut(follow.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text").withColumn("th", F.xxhash64("text"))
    kept = rows.join(gone, F.col("th").eqNullSafe(F.col("g_th")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left_anti")
    # only rows of an id that several have can be repeats
    several = shared.select("id").distinct()
    once = kept.join(several, F.col("doc_id") == F.col("id"), "left_anti").select("_row")
    repeats = kept.join(several, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id", "text"]).select("_row")
    return (once.unionByName(repeats) if shared.take(1) else once).select("_row.*")
