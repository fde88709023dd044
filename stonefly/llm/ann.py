"""Nearest neighbours by largest inner product over an inverted multi-index.

Each half of a vector is quantised by centroids of its own, so K centroids a
half make K^2 cells. A query takes the pairs of centroids in order of their
summed inner products, by a heap over the two sorted halves, and reranks the
members of the cells that it takes by the exact measure.

Where a query stops is calibrated for each query on the sample that the
centroids were fitted on: its ``k`` best sample members lie in cells of known
sums, and it goes on to the least of these. Of the true neighbours about k in
k + 1 lie before that point, and more where the sample is a small part of all
rows, as its best are then worse than the true ones. Close clusters end the
walk after a few cells. ``exact=True`` takes every cell. The k-th best score of
the sample is also one that the true k-th reaches, so no bucket sends on less.

Cells are packed into buckets of about ``BUCKET`` rows; a larger cell is split
over several by a hash of the id, so no group of equal vectors lands in one
task. Blocks of queries meet the buckets that one of them takes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stonefly.llm.common import Scratch

#: Numbers in the sample of the fit (rows times width) and rows at most; the sample goes to the driver and to each worker.
SAMPLE_NUMBERS, SAMPLE_ROWS = 4_000_000, 16_384
#: Rows that a cell should hold, bounds of K, rounds of the fit.
CELL, LEAST_K, MOST_K, ROUNDS, SEED = 64, 16, 1024, 12, 20240229
#: Rows of a bucket and queries of a block, about; queries scored together. With one query in twenty rows, buckets of half
#: a block's size move the fewest vectors.
BUCKET, BLOCK, CHUNK = 2048, 4096, 256


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows; half of a vector of width one is empty and has one."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(SEED)
    c = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    own = (c * c).sum(1)
    return np.concatenate([(own - 2 * p @ c.T).argmin(1) for p in np.array_split(x, len(x) // 8192 + 1)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Centroids, the sample with its cells, and where the rows of each cell are. Its size is bounded by ``MOST_K``
    and ``SAMPLE_NUMBERS`` whatever the corpus."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, rows: int, k: int):
        self.half = sample.shape[1] // 2
        centroids = min(MOST_K, max(LEAST_K, 1 << max(0, round(math.log2(math.sqrt(max(1, rows) / CELL))))))
        self.a, self.b = _fit(sample[:, : self.half], centroids), _fit(sample[:, self.half :], centroids)
        self.ids, self.sample, self.k = ids, sample, k
        self.cells = self.cell_of(sample)
        self.first = self.parts = np.zeros(0, np.int64)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.a) * len(self.b) + _nearest(x[:, self.half :], self.b)

    def place(self, cells: np.ndarray, counts: np.ndarray) -> int:
        """Pack the cells, in order, into buckets; returns their number."""
        n = np.zeros(len(self.a) * len(self.b), np.int64)
        n[cells] = counts
        self.first, self.parts = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
        bucket, held = 0, 0
        for c in np.flatnonzero(n):
            if n[c] > BUCKET:
                bucket += held > 0
                self.parts[c] = -(-n[c] // BUCKET)
                self.first[c] = bucket
                bucket, held = bucket + int(self.parts[c]), 0
                continue
            if held + n[c] > BUCKET:
                bucket, held = bucket + 1, 0
            self.first[c] = bucket
            held += int(n[c])
        self.used = n > 0
        return int(bucket + (held > 0))

    def bucket_of(self, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cells] + (mixed % self.parts[cells].astype(np.uint64)).astype(np.int64)

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.half] @ self.a.T, q[:, self.half :] @ self.b.T

    def stops(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the sum of centroids down to which it takes cells, and a score that its k-th neighbour reaches:
        that of its k-th in the sample."""
        out, floor = np.full(len(q), -np.inf), np.full(len(q), -np.inf)
        a, b = self.sums(q)
        for at in range(0, len(q), CHUNK):
            s = slice(at, at + CHUNK)
            score = q[s] @ self.sample.T
            score[ids[s, None] == self.ids[None, :]] = -np.inf
            if len(self.sample) <= self.k:
                continue
            best = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
            cells = self.cells[best]
            sums = np.take_along_axis(a[s], cells // len(self.b), 1) + np.take_along_axis(b[s], cells % len(self.b), 1)
            floor[s] = np.take_along_axis(score, best, 1).min(1)
            out[s] = np.where(np.isfinite(floor[s]), sums.min(1), -np.inf)
        return out, floor

    def walk(self, a: np.ndarray, b: np.ndarray, stop: float) -> Iterator[int]:
        """Cells in falling order of a[i] + b[j], down to ``stop``."""
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        i, j = (i * len(b)).tolist(), j.tolist()
        heap, stop = [(-a[0] - b[0], 0, 0)], stop - 1e-12
        while heap and -heap[0][0] >= stop:
            _, x, y = heapq.heappop(heap)
            yield i[x] + j[y]
            if y + 1 < len(b):
                heapq.heappush(heap, (-a[x] - b[y + 1], x, y + 1))
            if not y and x + 1 < len(a):
                heapq.heappush(heap, (-a[x + 1] - b[0], x + 1, 0))

    def buckets_of(self, a: np.ndarray, b: np.ndarray, stop: float) -> list[int]:
        cells = np.fromiter(self.walk(a, b, stop), np.int64)
        cells = cells[self.used[cells]]
        out = set(self.first[cells].tolist())
        for c in cells[self.parts[cells] > 1]:
            out.update(range(int(self.first[c]), int(self.first[c] + self.parts[c])))
        return sorted(out)


def _valid(batch: pa.RecordBatch, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part: right width, finite, not zero, with an id."""
    ids, vectors = batch.column(0), batch.column(1)
    right = pc.equal(pc.list_value_length(vectors), width).fill_null(False)
    keep = pc.and_(right, ids.is_valid())
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)  # nulls become NaN
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _unpacked(col: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width).astype(float)


def _best(ids: np.ndarray, x: np.ndarray, raw: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, taken: Callable, k: int) -> list[tuple[int, int, float]]:
    """Of each query the k best rows from its floor on whose cells are ``taken``. Products are summed without rounding, so equal vectors tie exactly."""
    found = []
    for at in range(0, len(q), CHUNK):
        score = q[at : at + CHUNK] @ x.T
        r, c = np.nonzero(score >= floor[at : at + CHUNK, None])
        keep = (q_ids[at + r] != ids[c]) & taken(at + r, c)
        r, c = r[keep], c[keep]
        own = score[r, c]
        ends = np.searchsorted(r, np.arange(len(score) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            near, row = c[ends[i] : ends[i + 1]], own[ends[i] : ends[i + 1]]
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                near = near[row >= edge - 1e-9 * max(1.0, abs(edge))]
            mine = q[at + i]
            if len(near) > 4 * k:  # many copies of a vector: one sum for all of them
                _, inverse = np.unique(raw[near], return_inverse=True)
                shown = np.zeros(inverse.max() + 1, np.int64)
                shown[inverse] = np.arange(len(near))
                sums = np.array([math.fsum((mine * x[near[s]]).tolist()) for s in shown])[inverse]
            else:
                sums = np.array([math.fsum(p) for p in (x[near] * mine).tolist()])
            order = np.lexsort((ids[near], -sums))[:k]
            found += [(int(q_ids[at + i]), int(ids[near[o]]), float(sums[o])) for o in order]
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that ``is_query`` holds for, its ``k`` nearest others.

    Rows without an id, and vectors that are null, zero, of another width than most, or hold a null or non-finite
    component, take no part. Ties go to the smaller id. A repeated row counts once; rows that share an id but not the
    vector are candidates each, and as queries share one list. No row is a neighbour of its own id. Further columns
    are ignored; no rows give no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    out_schema = "query_id bigint, vec_id bigint, score double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    widths = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sum(F.col("ask").cast("int")).alias("asked"))
    common = widths.orderBy(F.desc("n"), "width").first()
    if common is None or not common.asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, n, asked = common.width, common.n, common.asked

    size = max(2 * k, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    share = min(1.0, size / n)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _valid(b, width, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _packed(x)], names=["vec_id", "v"])

    got = picked.select("vec_id", "v").mapInArrow(sample, "vec_id bigint, v binary").toArrow()
    if not got.num_rows:
        if share == 1:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        got = rows.select("vec_id", "v").mapInArrow(sample, "vec_id bigint, v binary").limit(size).toArrow()
    # in order of ids; a repeated row counts once here too, or the k-th best would not be that of k rows
    once = sorted({(i, v) for i, v in zip(got.column("vec_id").to_pylist(), got.column("v").to_pylist(), strict=True)})
    index = Index(np.array([i for i, _ in once], np.int64), np.frombuffer(b"".join(v for _, v in once), kind).reshape(-1, width).astype(float), n, k)
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.column(2).to_numpy(zero_copy_only=False)
            for ask in (False, True):
                ids, x = _valid(b.filter(pa.array(kept == ask)), width, kind)
                cells = fitted.value.cell_of(x.astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cells), _packed(x), pa.array(np.full(len(ids), ask))], names=["vec_id", "cell", "v", "ask"])

    stored = scratch.cut(rows.mapInArrow(assign, "vec_id bigint, cell bigint, v binary, ask boolean"))
    counts = stored.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # one row a cell, K^2 at most
    if not counts.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n_buckets = index.place(counts.column("cell").to_numpy(), counts.column("n").to_numpy())
    together = max(1, BLOCK * n_buckets // asked)
    placed = spark.sparkContext.broadcast(index)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = placed.value
        for b in batches:
            ids, q = b.column(0).to_numpy(), _unpacked(b.column(2), kind, width)
            stops, floor = ix.stops(ids, q)
            stops = np.full(len(q), -np.inf) if exact else stops
            floor = floor - 1e-9 * np.maximum(1.0, np.abs(floor))  # what rounding may add
            sums = ix.sums(q)
            blocks = ix.bucket_of(ids, b.column(1).to_numpy()) // together
            at = [(x, r) for r in range(len(q)) for x in ix.buckets_of(sums[0][r], sums[1][r], stops[r])]
            which = np.array([r for _, r in at], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in at], pa.int64()), pa.array(blocks[which]), pa.array(ids[which]), b.column(2).take(pa.array(which)), pa.array(stops[which]), pa.array(floor[which])], names=["bucket", "block", "query_id", "q", "stop", "floor"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(placed.value.bucket_of(b.column(0).to_numpy(), b.column(1).to_numpy())), *b.columns[:3]], names=["bucket", "vec_id", "cell", "v"])

    asks = scratch.cut(stored.filter("ask").drop("ask").mapInArrow(ask, "bucket bigint, block bigint, query_id bigint, q binary, stop double, floor double"))
    there = stored.drop("ask").mapInArrow(spread, "bucket bigint, vec_id bigint, cell bigint, v binary")
    pairs = asks.groupBy("bucket", "block").count().select(F.col("bucket").alias("to"), F.col("block").alias("by"))
    meets = there.join(pairs, F.col("bucket") == F.col("to")).select("to", "by", "vec_id", "cell", "v")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ix, found = placed.value, []
        if left.num_rows and right.num_rows:
            row_ids, raw = left.column("vec_id").to_numpy(), np.array(left.column("v").to_pylist(), object)
            one = np.arange(len(row_ids))
            if len(np.unique(row_ids)) < len(row_ids):
                _, one = np.unique([f"{i}:{v.hex()}" for i, v in zip(row_ids, raw, strict=True)], return_index=True)
            row_ids, raw, cells = row_ids[one], raw[one], left.column("cell").to_numpy()[one]
            x = np.frombuffer(b"".join(raw), kind).reshape(-1, width).astype(float)
            q_ids, q, stop = right.column("query_id").to_numpy(), _unpacked(right.column("q"), kind, width), right.column("stop").to_numpy()
            a, b = ix.sums(q)
            i, j = cells // len(ix.b), cells % len(ix.b)
            found = _best(row_ids, x, raw, q_ids, q, right.column("floor").to_numpy(), lambda r, c: a[r, i[c]] + b[r, j[c]] >= stop[r] - 1e-9, k)
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    hits = meets.groupBy("to", "by").cogroup(asks.groupBy("bucket", "block")).applyInArrow(score, out_schema)
    ranked = hits.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
