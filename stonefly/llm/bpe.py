"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

The merges of a piece run on a segment tree over its byte positions. A leaf
holds the rank of the pair that starts there (with its position, so that equal
ranks give the leftmost), an inner node the least of its children. The root
names the next merge; the merge changes three leaves: the pair that starts at
the merged token, the one that ended in it, and the dead one of its right half.
Each is a walk from leaf to root.

Short pieces of a batch share one array of trees and take their merges in step;
a long piece has a tree of its own, so a run of n bytes without a break costs
n log n. A bounded cache keeps the ids of recent pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefly.llm.common import is_local, map_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Letters and numbers that the tiktoken library knows and the regex module, of an older Unicode version, doesn't.
NEWER_L = "՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
NEWER_N = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: Characters of text taken together; bounds the pieces held at once.
CHUNK = 2 << 20
#: Pieces of up to so many bytes share arrays of trees.
SHORT = 64
#: Leaves of the trees in one array at most.
LEAVES = 1 << 18
#: Pieces, of up to ``SHORT`` bytes each, in each of the cache's two generations.
CACHE = 120_000
NONE = np.int32(2**31 - 1)
#: Leaves of a tree for a piece of so many bytes.
_WIDTH = [max(2, 1 << (n - 1).bit_length()) if n else 2 for n in range(SHORT + 1)]


def widened(pattern: str) -> str:
    """The pattern with the newer letters and numbers in its classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 5]
        if two in (r"\p{L}", r"\p{N}"):
            own = two + (NEWER_L if two == r"\p{L}" else NEWER_N)
            out.append(own if inside else f"[{own}]")
            i += 5
            continue
        inside = {"[": True, "]": False}.get(pattern[i], inside)
        step = 2 if pattern[i] == "\\" else 1
        out.append(pattern[i : i + step])
        i += step
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank, on this machine or any file system that pyarrow opens."""
    if is_local(path):
        with open(path.removeprefix("file://"), "rb") as f:
            data = f.read()
    else:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            data = f.read()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """(left id, right id) -> rank of their merge, by open addressing in two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.mask = (1 << bits) - 1
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slots[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], np.array(merged, np.int32)[put]
            todo = todo[~(free & first)]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        top = max(ranks.values()) + 1
        self.ints = list(range(top))  # one object an id, shared by all cached tuples
        self.decimal = [str(i) for i in range(top)]
        self.bytes_of: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.plain, self.wide = regex.compile(pattern), regex.compile(widened(pattern))
        self.newer = regex.compile(f"[{NEWER_L}{NEWER_N}]")
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                return self.wide.findall(text)
        return self.plain.findall(text)

    def encode_texts(self, texts: Iterable[str | None]) -> Iterable[list[int]]:
        """Ids of each text in turn; null is empty."""
        held, size = [], 0
        for text in texts:
            held.append(self.pieces(text or ""))
            size += len(text or "")
            if size >= CHUNK:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[list[str]]) -> list[list[int]]:
        missing = set(chain.from_iterable(texts))
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing.difference_update(young)
        if old:
            again = {p: old[p] for p in missing if p in old}
            young.update(again)
            missing.difference_update(again)
        new, by_size, rank_of, ints = [], {}, self.ranks.get, self.ints
        for p in missing:
            b = p.encode()
            rank = rank_of(b)
            if rank is not None:
                young[p] = (ints[rank],)
            elif (n := len(b)) <= SHORT:
                by_size.setdefault(_WIDTH[n], []).append((p, b))
            else:
                new.append((p, b))
        long = {p: self.merge_long(b) for p, b in new}  # not kept: the cache is bounded in bytes
        for width, group in by_size.items():
            trees = LEAVES // width
            for at in range(0, len(group), trees):
                part = group[at : at + trees]
                for (p, _), ids in zip(part, self.merge_short([b for _, b in part], width), strict=True):
                    young[p] = ids
        if long:
            return [list(chain.from_iterable(long[p] if p in long else young[p] for p in t)) for t in texts]
        return [list(chain.from_iterable(map(young.__getitem__, t))) for t in texts]

    def merge_short(self, pieces: list[bytes], width: int) -> list[tuple]:
        """Trees of ``width`` leaves side by side: node k of tree r is ``tree[r, k]``, leaf i is node ``width + i``."""
        n, depth = len(pieces), width.bit_length() - 1
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        tok = np.full((n, width + 1), -1, np.int64)
        tok[:, :width] = self.byte_ids[raw]
        here = np.arange(width)
        live = here[None, :] < lens[:, None]
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        prv = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int32)
        pair = here[None, : width - 1] + 1 < lens[:, None]
        r, i = np.nonzero(pair)
        rank = self.pairs(tok[r, i], tok[r, i + 1])
        tree[r, width + i] = np.where(rank == NONE, NONE, rank * width + i)
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            key = tree[rows, 1]
            i, rank = key % width, key // width
            j = nxt[rows, i]
            k = nxt[rows, j]
            tok[rows, i] = rank
            live[rows, j] = False
            nxt[rows, i] = k
            prv[rows, k] = i
            p = prv[rows, i]
            # the leaves of the merged token, of its dead half and of its left neighbour
            right = k < lens[rows]
            mine = np.full(len(rows), NONE, np.int32)
            x = rows[right]
            got = self.pairs(tok[x, i[right]], tok[x, k[right]])
            mine[right] = np.where(got == NONE, NONE, got * width + i[right])
            left = p >= 0
            y = rows[left]
            got = self.pairs(tok[y, p[left]], tok[y, i[left]])
            theirs = np.where(got == NONE, NONE, got * width + p[left]).astype(np.int32)
            tree[rows, width + i], tree[rows, width + j] = mine, NONE
            tree[y, width + p[left]] = theirs
            rr, node = np.concatenate([rows, rows, y]), np.concatenate([i, j, p[left]]) + width
            for _ in range(depth):
                node >>= 1
                tree[rr, node] = np.minimum(tree[rr, 2 * node], tree[rr, 2 * node + 1])
            rows = rows[tree[rows, 1] != NONE]
        ids, ends, ints = tok[:, :width][live].tolist(), np.cumsum(live.sum(1)).tolist(), self.ints
        out, start = [], 0
        for end in ends:
            out.append(tuple([ints[x] for x in ids[start:end]]))
            start = end
        return out

    def merge_long(self, piece: bytes) -> tuple:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        get = self.ranks.get
        nxt, prv, end = list(range(1, n + 2)), list(range(-1, n)), list(range(1, n + 1))
        leaves = [none if (r := get(piece[i : i + 2])) is None or i + 1 >= n else r * width + i for i in range(n)]
        tree = [none] * width + leaves + [none] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] != none:
            i = tree[1] % width
            j = nxt[i]
            k = nxt[j]
            end[i] = end[j]
            nxt[i] = k
            prv[k] = i
            put(j, none)
            put(i, none if k >= n or (r := get(piece[i : end[k]])) is None else r * width + i)
            if (p := prv[i]) >= 0:
                put(p, none if (r := get(piece[p : end[i]])) is None else r * width + p)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = nxt[i]
        return tuple(ids)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[tuple, Encoder] = {}


def _encoder(token: str, shipped) -> Encoder:
    """One encoder a worker process and vocabulary, kept between tasks; its cache is dropped with each."""
    if token not in _encoders:
        _encoders.clear()
        _encoders[token] = Encoder(shipped.value)
    return _encoders[token]


def _forget() -> None:
    for e in _encoders.values():
        e.young, e.old = {}, {}


def _ship(spark, path: str):
    """The vocabulary (under 2 MB, whatever the corpus) goes to the workers once."""
    ranks = read_ranks(path)
    return hashlib.sha256(repr(len(ranks)).encode() + path.encode()).hexdigest(), spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` of every row of ``docs``; null and empty texts have no ids.

    Repeated rows are encoded as often, null ids stay null, further columns are ignored, no rows give no rows.
    """
    token, shipped = _ship(docs.sparkSession, vocabulary)

    def run(c: dict[str, list]) -> dict[str, list]:
        ids = [np.array(x, np.int32) for x in _encoder(token, shipped).encode_texts(c["text"])]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return {"doc_id": c["doc_id"], "n_tokens": pa.array(n), "ids": pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(flat))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col(text_col).alias("text")), run, f"doc_id {kind}, n_tokens bigint, ids array<int>", binary=(), done=_forget)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``bytes`` from ``ids``; ids cut inside a character give bytes that are no valid UTF-8, so bytes are returned."""
    token, shipped = _ship(encoded.sparkSession, vocabulary)

    def run(c: dict[str, list]) -> dict[str, list]:
        e = _encoder(token, shipped)
        return {"doc_id": c["doc_id"], "bytes": [e.decode(x or ()) for x in c["ids"]]}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, bytes binary", binary=())


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: one pass that encodes, decodes the ids and hashes both."""
    token, shipped = _ship(docs.sparkSession, vocabulary)

    def run(c: dict[str, list]) -> dict[str, list]:
        e, n, a, b = _encoder(token, shipped), [], [], []
        decimal = e.decimal.__getitem__
        for ids in e.encode_texts(c["text"]):
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return {"doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", binary=(), done=_forget)
