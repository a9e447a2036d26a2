"""Whitening of integer vectors: covariance by streaming rank-one updates, components by a symmetric QR eigen-solve.

Each task streams its distinct vectors through Welford's recurrence: with every vector the mean moves by a share of the
vector's distance, and the centred cross products grow by the product of the distances before and after. Tasks' states (count,
mean, cross products, and exact sums) merge by the parallel update formula, in groups first, so the driver merges a bounded
number. The driver then reduces the covariance to a tridiagonal matrix by reflections and diagonalises that by shifted QR
steps. What meets on the driver are states of d * d numbers; vectors never do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.exact_topk import usable
from lorewright.llm.shared import drop, written

SCALE, COMPONENTS = 256, 4
#: Merged states that reach the driver.
GROUPS = 32
STATE = "n long, mean array<double>, cross array<double>, high array<long>, low array<long>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LOW = (1 << 32) - 1


class State:
    """Count, mean and centred cross products of vectors; their exact sums as multiples of 2**32 and rests."""

    def __init__(self, wide: int):
        self.n, self.mean, self.cross = 0, np.zeros(wide), np.zeros((wide, wide))
        self.high, self.low = np.zeros(wide, np.int64), np.zeros(wide, np.int64)

    def add(self, rows: np.ndarray) -> None:
        """Integer rows, one rank-one update each."""
        self._sum((rows >> 32).sum(axis=0), (rows & _LOW).sum(axis=0))
        self.stream(rows.astype(np.float64))

    def stream(self, rows: np.ndarray) -> None:
        step = np.empty_like(self.cross)
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], (x - self.mean)[None, :], out=step)
            self.cross += step

    def merge(self, other: State) -> None:
        """The parallel update: both cross products and that of the means' distance."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.cross += other.cross + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.n = n
        self._sum(other.high, other.low)

    def _sum(self, high: np.ndarray, low: np.ndarray) -> None:
        low = self.low + low
        self.high, self.low = self.high + high + (low >> 32), low & _LOW

    def sums(self) -> list[int]:
        return [(int(h) << 32) + int(x) for h, x in zip(self.high, self.low, strict=True)]

    def covariance(self) -> np.ndarray:
        """Divisor n; the two triangles' rounding is averaged."""
        return (self.cross + self.cross.T) / (2 * max(self.n, 1))


def _sent(states: Iterable[State]) -> pa.RecordBatch:
    states = list(states)
    column = lambda get, kind: pa.array([get(s) for s in states], kind)
    doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [column(lambda s: s.n, pa.int64()), column(lambda s: s.mean, doubles), column(lambda s: s.cross.ravel(), doubles), column(lambda s: s.high, longs), column(lambda s: s.low, longs)],
        ["n", "mean", "cross", "high", "low"],
    )


def _received(n: int, mean: list, cross: list, high: list, low: list) -> State:
    state = State(len(mean))
    state.n, state.mean, state.cross = n, np.array(mean, np.float64), np.array(cross, np.float64).reshape(len(mean), -1)
    state.high, state.low = np.array(high, np.int64), np.array(low, np.int64)
    return state


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for i in range(batch.num_rows):
            state = _received(*[batch.column(c)[i].as_py() for c in ("n", "mean", "cross", "high", "low")])
            total = state if total is None else total
            if total is not state:
                total.merge(state)
    if total is not None:
        yield _sent([total])


def _gathered(states: DataFrame, wide: int) -> State:
    """The merge of all tasks' states."""
    total = State(wide)
    for r in states.repartition(GROUPS).mapInArrow(_merged, STATE).collect():
        total.merge(_received(*r))
    return total


def _rows(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    """The batch's integer vectors; shorter ones end in zeros."""
    column = batch.column("x")
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(at)
    if len(lengths) and (lengths == wide).all():
        return values[at[0] : at[-1]].reshape(-1, wide)
    out = np.zeros((batch.num_rows, wide), np.int64)
    for i, n in enumerate(lengths):
        out[i, :n] = values[at[i] : at[i + 1]]
    return out


def _fitted(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(wide)
        for batch in batches:
            state.add(_rows(batch, wide))
        yield _sent([state])

    return run


def _whitened_moments(wide: int, mean: np.ndarray, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(axes.shape[1])
        for batch in batches:
            state.stream((_rows(batch, wide) - mean) @ axes)
        yield _sent([state])

    return run


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, sub-diagonal, and the orthogonal q with q.T @ matrix @ q tridiagonal, by Householder reflections."""
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix; a vector's largest entry is positive.

    Implicit QR steps with the shift of the last 2 x 2 block chase a bulge down each unreduced block of the tridiagonal
    matrix until its last sub-diagonal entry is below rounding."""
    diagonal, below, q = tridiagonal(matrix)
    vectors = q.T.copy()  # rows, as rotations then touch contiguous memory
    end, steps, limit = len(diagonal) - 1, 0, 60 * max(len(diagonal), 1)
    negligible = lambda i: abs(below[i]) <= np.finfo(float).eps * (abs(diagonal[i]) + abs(diagonal[i + 1]))
    while end > 0:
        if negligible(end - 1):
            below[end - 1] = 0.0
            end -= 1
            continue
        start = end - 1
        while start > 0 and not negligible(start - 1):
            start -= 1
        steps += 1
        if steps > limit:
            raise ArithmeticError("the QR steps don't settle")
        half = (diagonal[end - 1] - diagonal[end]) / 2
        root = np.hypot(half, below[end - 1])
        shift = diagonal[end] - below[end - 1] ** 2 / (half + (root if half >= 0 else -root))
        x, z = diagonal[start] - shift, below[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                below[k - 1] = r
            a, b, e = diagonal[k], diagonal[k + 1], below[k]
            diagonal[k], diagonal[k + 1] = c * c * a + 2 * c * s * e + s * s * b, s * s * a - 2 * c * s * e + c * c * b
            below[k] = c * s * (b - a) + (c * c - s * s) * e
            one, two = vectors[k].copy(), vectors[k + 1]
            vectors[k] = c * one + s * two
            vectors[k + 1] = c * two - s * one
            if k < end - 1:
                x, z = below[k], s * below[k + 1]
                below[k + 1] *= c
    order = np.argsort(-diagonal, kind="stable")
    vectors = vectors[order]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return diagonal[order], (vectors * signs[:, None]).T


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact; None beyond 64 bits."""
    most = n * int(np.abs(rows.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62 and most**2 * max(len(sums), 1) < 2**62:
        return (((n * rows - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = ((n * rows.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(x) if x < 2**63 else None for x in exact]


def _projected(wide: int, fit: State, axes: np.ndarray, explained: list[float], error: float):
    n, sums, k = fit.n, fit.sums(), axes.shape[1]
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch, wide)
            scores = ((rows - mean) @ axes).ravel()
            each = np.repeat(np.arange(len(rows)), k)
            share, component = np.tile(explained, len(rows)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))
            columns = [
                batch.column("vec_id").take(pa.array(each)), pa.array(component), pa.array(np.full(len(each), n)),
                pa.array(_deviations(rows, n, sums), pa.int64()).take(pa.array(each)), pa.array(scores, mask=np.isnan(scores)), pa.array(share, mask=np.isnan(share)),
                pa.array([None if np.isnan(error) else error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def integers(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable row's projections on the first
    components, whitened.

    vectors: vec_id long, embedding array of numbers; other columns are left, whatever their names. Rows whose vector is null
    or holds null or non-finite entries go. An entry c counts as floor(scale * c), c as double. The fit list is each
    distinct integer vector once, so rows that repeat weigh nothing; each row still gives its rows, also with a null vec_id.
    Shorter vectors end in zeros. deviation is exact, and null where it exceeds 64 bits. A component whose eigenvalue is zero to
    rounding (fewer distinct vectors than components, constant ones) can't be whitened: its whitened is null, as is
    explained where the trace is zero; identity_error is over the others, null where there is none. Vectors of d entries have
    min(components, d) components. Empty tables and tables without usable rows give no rows."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding"), scale).alias("x"))
    wide = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not wide:
        return spark.createDataFrame([], RESULT)
    padded = F.when(F.size("x") < wide, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("x")))).otherwise(F.col("x"))
    distinct = written(rows.select(padded.alias("x")).distinct(), "distinct")
    fit = _gathered(distinct.mapInArrow(_fitted(wide), STATE), wide)
    covariance = fit.covariance()
    values, axes = eigen(covariance)
    trace, k = float(np.trace(covariance)), min(components, wide)
    values, axes = values[:k], axes[:, :k]
    sound = values > trace * wide * 4 * np.finfo(float).eps
    scaled = np.where(sound, axes / np.sqrt(np.where(sound, values, 1.0)), np.nan)
    error = float("nan")
    if sound.any():
        moments = _gathered(distinct.mapInArrow(_whitened_moments(wide, fit.mean, scaled[:, sound]), STATE), int(sound.sum()))
        error = float(np.abs(moments.covariance() - np.eye(int(sound.sum()))).max())
    drop(distinct)
    explained = [float(v) / trace if trace else float("nan") for v in values]
    return rows.mapInArrow(_projected(wide, fit, scaled, explained, error), RESULT)
