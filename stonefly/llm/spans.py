"""Substring dedup by sliding spans of sentences.

A text is cut into sentences, and a sentence of more than ``PIECE`` words into
pieces at places that its words define. From each sentence a span runs over ``RUN`` sentences, or further until
it has ``LEAST_WORDS`` words, and is known by 128 bits of hash of its words in
lower case. Of the places of a span over all documents the first, by id and
position, stays; sentences covered by any other are removed.

Each batch of documents marks its own later places, so a span however common
sends one place a batch to where its places meet, not one a document; the later
ones are known and go along anywhere. All is one shuffle, sorted by hash, and
places are compared as they stream by. Texts that lose nothing are not exchanged
where the keys of those that do are few enough to be sent to all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonefly.llm.common import Scratch, slices

#: Sentences and words of a span at least; words of a piece of a long sentence at most; one word in so many ends a piece.
RUN, LEAST_WORDS, PIECE, PICK = 3, 38, 16, 8
#: Documents that lose something, two numbers each, whose keys are broadcast at most.
MOST_KEYS = 1_000_000
#: Where a sentence ends: a stop, closing marks and white space, or the line.
_STOP = re.compile(rb"""(?:[.!?]|\xe3\x80\x82|\xef\xbc[\x81\x9f])["')\]]*[ \t\r\x0b\x0c]+|\n+""")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cuts(words: list[bytes]) -> list[int]:
    """Where the pieces of a long sentence begin, and its end: after words that a checksum picks, so that a word more or
    less in one copy moves the cuts only up to the next such word, and after ``PIECE`` words at the latest."""
    cuts = [0]
    for i, w in enumerate(words, 1):
        if not crc32(w) % PICK or i - cuts[-1] == PIECE:
            cuts.append(i)
    return cuts if cuts[-1] == len(words) else [*cuts, len(words)]


def sentences(b: bytes) -> list[tuple[int, int, int, bytes]]:
    """Start, end (up to the next start), number of words and hash of each sentence or piece. All bytes from the first to the last word lie in one."""
    out = []
    at = 0
    digest = xxhash.xxh3_128_digest
    for end in [*(m.end() for m in _STOP.finditer(b)), len(b)]:
        words = b[at:end].lower().split()
        n = len(words)
        if not n:
            continue  # what follows begins here
        if n <= PIECE:
            out.append((at, end, n, digest(b" ".join(words))))
        else:
            starts = [m.start() for m in _WORD.finditer(b, at, end)]
            starts[0] = at
            cuts = _cuts(words)
            for k, m in zip(cuts, cuts[1:], strict=False):
                out.append((starts[k], starts[m] if m < n else end, m - k, digest(b" ".join(words[k:m]))))
        at = end
    return out


def spans(units: list[tuple[int, int, int, bytes]], run: int = RUN, least: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """First sentence, number of sentences and hash of each span."""
    n, out, end, words = len(units), [], 0, 0
    digest, marks = xxhash.xxh3_128_digest, [u[3] for u in units]
    for i in range(n):
        while end < n and (end - i < run or words < least):
            words += units[end][2]
            end += 1
        if end - i < run or words < least:
            break
        out.append((i, end - i, digest(b"".join(marks[i:end]))))
        words -= units[i][2]
    return out


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Places that are not the first of their hash; documents that are alike share a number and so are both first."""
    order = np.lexsort((pos, doc, h2, h1))
    a, b, d, p = h1[order], h2[order], doc[order], pos[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.zeros(len(a), bool)
    out[order] = (d != d[first]) | (p != p[first])
    return out


_PLACE = ["h1", "h2", "id", "th", "pos", "len", "later"]


def _places(run: int, least: int, id_type: pa.DataType):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            counts, pos, size, hashes = [], [], [], []
            for part in slices(iter([batch])):
                found = [spans(sentences(b), run, least) if b else [] for b in part.column(1).cast(pa.binary()).to_pylist()]
                counts += map(len, found)
                pos.append(np.array([f[0] for x in found for f in x], np.int32))
                size.append(np.array([f[1] for x in found for f in x], np.int32))
                hashes.append(b"".join(f[2] for x in found for f in x))
            if not any(counts):
                continue
            doc = np.repeat(np.arange(len(counts)), counts)
            # a number for each document in the order of id and text mark; nulls first
            keys = sorted({(i is not None, i if i is not None else 0, int(m)) for i, m in zip(ids, marks, strict=True)})
            number = {k: n for n, k in enumerate(keys)}
            ranks = np.array([number[(i is not None, i if i is not None else 0, int(m))] for i, m in zip(ids, marks, strict=True)])
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            pos = np.concatenate(pos)
            later = _later(h[:, 0], h[:, 1], ranks[doc], pos)
            cols = [h[:, 0].copy(), h[:, 1].copy(), pa.array(ids, id_type).take(pa.array(doc)), marks[doc], pos, np.concatenate(size), later]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=_PLACE)

    return places


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over places sorted by hash, id, mark and position: those that differ from the first of their hash, and those that
    are known to."""
    held: pa.RecordBatch | None = None  # the first place of the hash that the last batch ended in
    short = ["id", "th", "pos", "len"]
    for batch in batches:
        known = batch.column("later")
        yield batch.filter(known).select(short)
        batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h1, h2, th, pos = (whole.column(c).to_numpy() for c in ("h1", "h2", "th", "pos"))
        coded = whole.column("id").dictionary_encode().indices.fill_null(-1).to_numpy()
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        later = (coded != coded[first]) | (th != th[first]) | (pos != pos[first])
        yield whole.filter(pa.array(later)).select(short)
        held = whole.slice(int(first[-1]), 1)


def repeated(keyed: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """keyed: ``id``, ``text``, ``th`` (a hash of the text). Returns ``id``, ``th``, ``cover`` (pos and len of the spans that are not first)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = keyed.schema["id"].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in zip(_PLACE, [T.LongType(), T.LongType(), kind, T.LongType(), T.IntegerType(), T.IntegerType(), T.BooleanType()], strict=True)])
    found = keyed.select("id", "text", "th").mapInArrow(_places(run, least, to_arrow_type(kind)), schema)
    short = T.StructType([schema[n] for n in ("id", "th", "pos", "len")])
    where = F.when(F.col("later"), F.xxhash64("id", "th", "pos")).otherwise(F.xxhash64("h1", "h2"))
    every = found.repartition(where).sortWithinPartitions("h1", "h2", "id", "th", "pos").mapInArrow(_scan, short)
    # a document's spans are as many as its sentences
    return every.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "len")).alias("cover"))


def _cut(b: bytes, cover: list[dict]) -> tuple[bytes, list[tuple[int, int]], int]:
    """The rest of the text, the byte ranges removed, and the number of sentences removed."""
    units = sentences(b)
    gone = np.zeros(len(units) + 1, np.int64)
    for c in cover:
        gone[c["pos"]] += 1
        gone[c["pos"] + c["len"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    ranges: list[list[int]] = []
    for u in np.flatnonzero(gone):
        s, e = units[u][:2]
        if ranges and ranges[-1][1] == s:
            ranges[-1][1] = e
        else:
            ranges.append([s, e])
    parts, at = [], 0
    for s, e in ranges:
        parts.append(b[at:s])
        at = e
    return b"".join(parts) + b[at:], [tuple(r) for r in ranges], int(gone.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """For every row: ``doc_id``, ``text`` without repeats, ``n_removed`` (sentences or pieces taken out), ``removed``
    (start:end of their ranges, in code points of the text as it was, end exclusive, comma-joined).

    Null texts stay null and have no sentences; empty and blank texts, and those too short for a span, stay as they
    are. Ids order the places, null ids first; rows with equal ids go by a hash of the text, and rows alike in both
    keep and lose the same. Further columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    cover = Scratch(docs.sparkSession).cut(repeated(keyed, run, least).select(F.col("id").alias("c_id"), F.col("th").alias("c_th"), "cover"))
    own = F.col("th").eqNullSafe(F.col("c_th")) & F.col("id").eqNullSafe(F.col("c_id"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, gone, removed = [], [], []
            for b, c in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rest, ranges, k = _cut(b, c) if c else (b, [], 0)
                text.append(rest)
                gone.append(k)
                removed.append(",".join(_points(b, ranges)) if ranges else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(batch.schema.field(1).type), pa.array(gone, pa.int64()), pa.array(removed)], names=schema.names)

    if cover.count() > MOST_KEYS:
        return keyed.join(cover, own, "left").select("id", "text", "cover").mapInArrow(apply, schema)
    few = F.broadcast(cover.select("c_id", "c_th"))
    whole = keyed.join(few, own, "left_anti").select(F.col("id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("removed"))
    cut = keyed.join(few, own, "left_semi").join(cover, own).select("id", "text", "cover").mapInArrow(apply, schema)
    return whole.unionByName(cut)


def _points(b: bytes, ranges: list[tuple[int, int]]) -> list[str]:
    out, at, n = [], 0, 0
    for s, e in ranges:
        n += len(b[at:s].decode())
        m = n + len(b[s:e].decode())
        out.append(f"{n}:{m}")
        n, at = m, e
    return out
