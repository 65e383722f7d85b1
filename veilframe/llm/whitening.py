"""Embedding whitening by hierarchical merging of singular value decompositions.

Vectors become whole numbers, x = floor(256 * c). Each partition of the distinct x keeps their number, exact sums, mean and
all singular values and right vectors of its centred rows. Two such states are merged by stacking both sets of scaled
vectors and one row for the difference of the means, and decomposing the stack again: the Gram matrix of the stack is that
of the rows taken together, so nothing is lost, whatever the rank. Merges form a tree of bounded fan-in; the driver sees
the last state, whose size depends on the dimension alone.

Edge cases: a vector that is null, empty or holds null or non-finite entries gives no row; nor does one with an entry of
2**23 or more, whose x would not fit in 31 bits, nor one whose length isn't the table's most common (ties: the longest).
Equal vectors count once in the fit and give rows each. Directions without variance (below 1e-12 of the whole) have no
unit scale and give no component, so one distinct vector, or an empty table, gives no rows. A deviation beyond a long is
null. Null vec_ids stay null; further columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import checkpointed, through_parquet

SCALE = 256
LARGEST = 1 << 23  # entries from here on give no row
BATCH = 4_096  # rows decomposed at once
STATE_BYTES = 64 << 20  # of states that one task of the tree merges
FLAT = 1e-12  # share of the whole variance below which a direction has none
_STATE = "slot bigint, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"


@dataclass
class State:
    """n rows: exact sums, mean, and singular values and right vectors (rows) of what is left after the mean is taken off."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        sums = x.sum(0)
        mean = sums / len(x)
        return cls(len(x), sums, mean, *_decomposed(x - mean))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        between = np.sqrt(self.n) * np.sqrt(other.n / n) * (self.mean - other.mean)
        sums = self.sums + other.sums
        stack = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, between[None, :]])
        return State(n, sums, sums / n, *_decomposed(stack))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors of the rows; of more rows than columns, first the triangle of their QR."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


@dataclass
class Model:
    """The fit: number and sums of the distinct x, eigenvalues of their covariance (falling), unit eigenvectors (rows)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    def components(self, most: int) -> int:
        """Number of components that have variance, `most` at most."""
        return int((self.values[:most] > FLAT * self.trace).sum()) if self.trace > 0 else 0

    def projected(self, x: np.ndarray, k: int) -> np.ndarray:
        return (x - self.sums / self.n) @ (self.vectors[:k] / np.sqrt(self.values[:k, None])).T


def whole(c: Column) -> Column:
    """x of a vector, as array<int>; null for vectors that give no row, but for those of an odd length."""
    good = F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < LARGEST)) & (F.size(c) > 0)  # NaN is above every number
    return F.when(good, F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("int")))


def numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x of the rows that give results."""
    rows = vectors.select(F.col(key).cast("bigint").alias(key), whole(F.col(vector)).alias("x")).filter("x is not null")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (most.d if most else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), -1)


def _row(slot: int, s: State) -> pa.RecordBatch:
    each = [[slot], [s.n], [s.sums.tolist()], [s.mean], [s.values], [s.vectors.ravel()]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(each, kinds)], ["slot", "n", "sums", "mean", "values", "vectors"])


def _states(t: pa.Table) -> Iterator[State]:
    for r in t.sort_by("slot").to_pylist():
        d = len(r["sums"])
        yield State(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"]), np.array(r["values"]), np.array(r["vectors"]).reshape(-1, d))


def fit(distinct: DataFrame) -> Model | None:
    """The model of distinct(x), whose x are of one length; None without rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for b in batches:
            for i in range(0, len(b), BATCH):
                new = State.of(_matrix(b.column(0).slice(i, BATCH)))
                state = new if state is None else state.merged(new)
        if state is not None:
            yield _row(TaskContext.get().partitionId(), state)

    def merge(t: pa.Table) -> pa.Table:
        every = _states(t)
        state = next(every)
        for s in every:
            state = state.merged(s)
        return pa.Table.from_batches([_row(t.column("slot")[0].as_py() if len(t) else 0, state)])

    states = checkpointed(distinct.select("x").mapInArrow(local, _STATE))
    while True:
        seen = states.agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top"), F.max(F.size("sums")).alias("d")).first()
        fan = max(2, min(64, STATE_BYTES // (8 * (seen.d or 1) ** 2)))
        if seen.n <= fan:
            break
        states = checkpointed(states.withColumn("_g", F.expr(f"slot div {fan}")).groupBy("_g").applyInArrow(merge, _STATE).withColumn("slot", F.expr(f"slot div {fan}")))
    last = states.toArrow()
    if not len(last):
        return None
    (s,) = _states(merge(last))
    return Model(s.n, s.sums, s.values**2 / s.n, s.vectors)


def identity_error(distinct: DataFrame, model: Model, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened distinct x minus the identity, measured over all of them."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total, square = shared.value, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = m.projected(_matrix(b.column(0)), k)
            total += w.sum(0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([*range(k), *range(k, k + k * k)], pa.int64()), pa.array(np.concatenate([total, square.ravel()]))], ["i", "v"])

    got = dict(distinct.select("x").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v")).collect())
    mean = np.array([got[i] for i in range(k)]) / model.n  # of numbers that are centred already: what rounding has left
    cov = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n * x - S)**2 for each row, exact."""
    most = (n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))) ** 2 * max(1, x.shape[1])
    if most < 1 << 63:
        return pa.array(((n * x - sums) ** 2).sum(1), pa.int64())
    each = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in each], pa.int64())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 4) -> DataFrame:
    """A row for each row of vectors that has a result and each of the first `most` components: key, component (from 1), n,
    deviation, whitened, explained, identity_error. One shuffle, of the distinct x, which are counted before they move."""
    rows = numbers(vectors, key, vector)
    distinct = through_parquet(rows.select("x").distinct())
    model = fit(distinct)
    k = model.components(most) if model else 0
    shape = f"{key} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], shape)
    error, names = identity_error(distinct, model, k), [x.split()[0] for x in shape.split(", ")]
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        part = m.values[:k] / m.trace
        for b in batches:
            for i in range(0, len(b), BATCH):
                x = _matrix(b.column(1).slice(i, BATCH))
                each = np.repeat(np.arange(len(x)), k)
                cols = [b.column(0).slice(i, BATCH).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)), deviations(x, m.n, m.sums).take(pa.array(each))]
                cols += [pa.array(m.projected(x, k).ravel()), pa.array(np.tile(part, len(x))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, shape)
