"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

The cosines of random projections of a text's statistics approximate a Gaussian
kernel. Partitions sum their normal equations and the driver adds up at most
``FIT_PARTITIONS`` of them, each of fixed size. A quarter of the training rows
stays out of the fit and gives, in ``BINS`` counts, the isotonic map from raw
score to probability.

The fit takes at most about ``FIT_ROWS`` labelled rows, picked by a hash of the
id; scoring covers every row and is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefly.llm.common import Scratch, map_batches, slices
from stonefly.llm.textstats import NAMES, vector

FIT_ROWS, FIT_PARTITIONS = 200_000, 8
FEATURES, GAMMA, RIDGE, SEED = 256, 0.05, 0.3, 20240229
BINS, LOW, HIGH = 2000, -0.5, 1.5
THRESHOLD = 0.3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    x: np.ndarray
    y: np.ndarray

    def features(self, v: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(len(NAMES), FEATURES)) * np.sqrt(2 * GAMMA)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((v - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])

    def raw(self, v: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(v))
        return np.concatenate([self.features(p) @ self.weights for p in np.array_split(v, max(1, len(v) // 2048))]) if len(v) else np.zeros(0)

    def score(self, v: np.ndarray) -> np.ndarray:
        """Probability of label 1; the calibrated steps are joined by lines, and a trace of the raw score keeps order within flat parts."""
        raw = self.raw(v)
        return 0.998 * np.interp(raw, self.x, self.y) + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30)))


def isotonic(x: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of ``x``: block centres and their shares of ones."""
    blocks: list[list[float]] = []
    for xi, o, t in zip(x, ones, total, strict=True):
        blocks.append([xi * t, float(o), float(t)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    xs, o, t = (np.array([b[i] for b in blocks]) for i in range(3))
    return xs / t, (o + 0.5) / (t + 1)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``v``: the statistics of every row's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "v": [vector(t) for t in c["text"]]}, f"doc_id {kind}, v array<double>")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _sums(df: DataFrame, f, width: int) -> np.ndarray:
    """Sum of ``f`` (batch of vectors and labels -> array of ``width``) over the rows: one array a partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b.column("v")), b.column("y").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return sum((np.frombuffer(r.s) for r in df.mapInArrow(run, "s binary").toLocalIterator()), np.zeros(width))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def training(labels: DataFrame, scratch: Scratch, label: str = "quality") -> DataFrame:
    """``doc_id``, ``y``: the labels that may train, cut by a hash of the id to about ``FIT_ROWS``, which bounds what is
    broadcast. Null labels and ids train nothing, of repeated labels the least counts."""
    usable = labels.filter(F.col(label).isNotNull() & ~held_out())
    own = scratch.cut(usable.groupBy("doc_id").agg((F.min(label) >= 1).cast("int").alias("y")))
    count = own.count()
    if count > FIT_ROWS:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / count))
    return F.broadcast(own)


def fit(stats: DataFrame, train: DataFrame, scratch: Scratch) -> Model:
    """stats: as ``statistics`` returns; train: as ``training`` returns. Of rows that share an id the one of least
    statistics trains. Without training rows every score is one half."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0
    # the sample is cut first and has a proven bound, so the statistics meet it where they are; only it is exchanged
    once = stats.join(train, "doc_id").groupBy("doc_id").agg(F.min(F.struct("v", "y")).alias("r"))
    rows = scratch.cut(once.select("r.v", "r.y", part.alias("calibrate")).repartition(FIT_PARTITIONS))
    model = _fitted(rows.coalesce(FIT_PARTITIONS))
    scratch.drop(rows)
    return model


def _fitted(rows: DataFrame) -> Model:
    """rows: ``v``, ``y``, ``calibrate``, few and on storage; read once for each sum."""
    k = len(NAMES)
    m = _sums(rows, lambda v, y: np.r_[len(v), v.sum(0), (v * v).sum(0), y.sum()], 2 * k + 2)
    if not m[0]:
        return Model(np.zeros(k), np.ones(k), None, np.zeros(1), np.full(1, 0.5))
    mean = m[1 : k + 1] / m[0]
    scale = np.sqrt(np.maximum(m[k + 1 : 2 * k + 1] / m[0] - mean**2, 1e-9))
    model = Model(mean, scale, None, np.zeros(1), np.full(1, (m[-1] + 0.5) / (m[0] + 1)))
    if m[-1] in (0, m[0]):
        return model
    d = 1 + k + FEATURES

    def normal(v: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = model.features(v)
        return np.r_[(p.T @ p).ravel(), p.T @ y]

    s = _sums(rows.filter("not calibrate"), normal, d * d + d)
    weights = np.linalg.solve(s[: d * d].reshape(d, d) + RIDGE * np.eye(d), s[d * d :])
    model.weights = weights

    def bins(v: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(v) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
        return np.r_[np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS)]

    c = _sums(rows.filter("calibrate"), bins, 2 * BINS)
    ones, total = c[:BINS], c[BINS:]
    used = np.flatnonzero(total)
    if len(used):
        model.x, model.y = isotonic(LOW + (used + 0.5) * (HIGH - LOW) / BINS, ones[used], total[used])
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null, empty and blank texts have zero statistics and are scored by them. A null id is held out of training and
    ``held_out`` is null for it; repeated rows repeat; further columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.cut(statistics(docs))
    model = fit(stats, training(labels, scratch), scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b.column("v"))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, all columns as they were. Texts stay where they are: no
    shuffle, and only those of the training sample are measured before they are scored.

    Null, empty and blank texts have zero statistics and are scored by them; rows with a null id train nothing and are
    scored; repeated rows share their fate; further columns pass; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    train = training(labels, scratch)
    sample = docs.select("doc_id", "text").join(F.broadcast(train.select("doc_id")), "doc_id", "left_semi")
    model = fit(statistics(sample), train, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            v = np.array([vector(t) for t in b.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(v) >= threshold))

    return docs.mapInArrow(run, docs.schema)
