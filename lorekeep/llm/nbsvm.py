"""Quality classifier: naive Bayes support vectors.

Features are hashed n-gram indicators of a whole text: words with their
punctuation and case folded to shapes, and byte n-grams. Each indicator is
scaled by its log-count ratio (how much likelier it is in class 1 than in class
0) and a linear hinge-loss model is fitted to the scaled, unit-length vectors by
dual coordinate descent. A logistic curve fitted on rows that the model has not
seen turns margins into scores.

The model is fitted on at most `sample` labelled rows (those with the smallest
hash of their id; documented bound), so model and sample are of fixed size, at
most 8 KB a row; the rows are found by a broadcast of the sampled ids and
featurised in tasks. Every row of the table is scored from its whole text.

Defined cases: a null text counts as empty and is scored from the bias alone; a
label other than 0 or 1 is ignored; of contradicting labels of one id the
smaller holds; labels of one class only give that class's value as the score of
every row; no labels at all give 0.5; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import forget

BITS = 16
SAMPLE = 6_000
#: Bytes hashed in one numpy step.
STEP = 1 << 20


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers: byte 1- to 3-grams, and 4- and 6-grams of word shapes."""
    seen = np.zeros(1 << bits, bool)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shift = np.uint32(32 - bits)

    def mark(values: np.ndarray, grams: tuple[tuple[int, int], ...]) -> None:
        for n, seed in grams:
            if len(values) < n:
                continue
            h = np.full(len(values) - n + 1, seed, np.uint32)
            for i in range(n):
                h = (h ^ values[i : len(values) - n + 1 + i]) * np.uint32(0x01000193)
            seen[(h * np.uint32(0x9E3779B1)) >> shift] = True

    tail = np.zeros(0, np.uint32)
    for at in range(0, len(data), STEP):
        mark(data[at : at + STEP + 2].astype(np.uint32), ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)))
        # shapes: lower, upper, digit, space, other ASCII, beyond ASCII; a run of one is one, across steps too
        kind = SHAPES[data[at : at + STEP]]
        run = kind[np.concatenate((tail[-1:] != kind[:1] if len(tail) else [True], kind[1:] != kind[:-1]))]
        run = np.concatenate((tail, run))
        mark(run, ((4, 0x27D4EB2F), (6, 0x165667B1)))
        tail = run[-5:]
    return np.flatnonzero(seen).astype(np.uint32)


def packed(x: np.ndarray, bits: int = BITS) -> bytes:
    """A set of features as numbers or as a bitmap, whichever is shorter: at most 2 ** bits / 8 bytes."""
    if 4 * len(x) < 1 << bits >> 3:
        return x.astype("<u4").tobytes()
    held = np.zeros(1 << bits, bool)
    held[x] = True
    return np.packbits(held, bitorder="little").tobytes()


def unpacked(raw: bytes, bits: int = BITS) -> np.ndarray:
    if len(raw) < 1 << bits >> 3:
        return np.frombuffer(raw, "<u4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))


def _shapes() -> np.ndarray:
    kind = np.full(256, 5, np.uint32)
    kind[:128] = 4
    for low, high, k in ((97, 123, 0), (65, 91, 1), (48, 58, 2)):
        kind[low:high] = k
    kind[[9, 10, 11, 12, 13, 32]] = 3
    return kind


SHAPES = _shapes()


@dataclass
class Model:
    """Weights of the indicators (log-count ratio times coefficient), bias, and the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    constant: float | None = None
    ratio: np.ndarray | None = None

    def margin(self, x: np.ndarray) -> float:
        """Of a set of features, scaled to unit length."""
        if self.constant is not None or not len(x):
            return self.bias
        norm = float(np.sqrt((self.ratio[x] ** 2).sum())) or 1.0
        return float(self.weights[x].sum()) / norm + self.bias

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratio(rows: list[bytes], y: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << bits), alpha)
    for x, label in zip(rows, y, strict=True):
        counts[int(label), unpacked(x, bits)] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[bytes], r: np.ndarray, y: np.ndarray, bits: int = BITS, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights, bias and duality gap (a share of the primal value) of the L2-regularised hinge-loss model.

    A row is its indicators times `r`, at unit length, and a constant feature of one.
    """
    w, bias = np.zeros(1 << bits), 0.0
    signs, a = np.where(y > 0, 1.0, -1.0), np.zeros(len(y))
    # the rarer class counts as much as the other
    share = np.array([(y == 0).sum(), (y == 1).sum()], float)
    costs = cost * (len(y) / (2 * share))[y.astype(int)]

    def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
        x = unpacked(rows[i], bits)
        v = r[x]
        return x, v / (np.linalg.norm(v) or 1.0)

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            x, v = vector(i)
            gradient = signs[i] * (w[x] @ v + bias) - 1
            new = min(max(a[i] - gradient / 2.0, 0.0), costs[i])  # |x|^2 + 1 = 2
            if (step := new - a[i]) != 0:
                w[x] += step * signs[i] * v
                bias += step * signs[i]
                a[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    norm = w @ w + bias * bias
    losses = [max(0.0, 1 - signs[i] * (w[x] @ v + bias)) for i in range(len(y)) for x, v in (vector(i),)]
    primal = norm / 2 + float(costs @ losses)
    return w, bias, (primal - (a.sum() - norm / 2)) / primal


def _logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with softened targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack((margins, np.ones(len(y))))
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t))
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[bytes], y: np.ndarray, bits: int = BITS) -> Model:
    """A model from packed features and labels; every fifth row only fits the logistic curve."""
    none = np.zeros(1 << bits)
    if not len(y) or y.min() == y.max():
        return Model(none, 0.0, 0.0, 0.0, 0.5 if not len(y) else float(y[0]), none)
    keep = np.arange(len(y)) % 5 != 0
    if len(set(y[keep])) < 2 or len(set(y[~keep])) < 2:
        keep[:] = True
    train = np.flatnonzero(keep)
    chosen = [rows[i] for i in train]
    r = log_count_ratio(chosen, y[train], bits)
    w, bias, _ = dual_coordinate_descent(chosen, r, y[train], bits)
    model = Model(w * r, bias, 1.0, 0.0, None, r)
    rest = np.flatnonzero(~keep) if not keep.all() else train
    model.slope, model.offset = _logistic(np.array([model.margin(unpacked(rows[i], bits)) for i in rest]), y[rest])
    return model


def held_out(id_col: str):
    """Rows whose CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                x = [packed(features(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary()), part.column(2)], names=["id", "x", "y"])

    # the join's small side has `sample` rows at most; repeated document ids add their rows
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id").select(F.col("_id").cast("string").alias("id"), F.col("_text").alias("text"), F.col("_y").alias("y"))
    got = picked.mapInArrow(run, "id string, x binary, y int").orderBy(F.xxhash64("id"), "id", "x").limit(sample).toPandas()
    return fit(list(got["x"]), got["y"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        for batch in batches:
            values = pa.array([m.score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold; texts pass the model once and are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keep = [shared.value.score(t.as_py()) >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # by number: a name may hold a dot
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
