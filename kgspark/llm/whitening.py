"""Whitening of embeddings; principal components by FEAST contour integration.

Entries become whole numbers, x = floor(64 * c) + 1000000. Two passes over the vectors
give, as sums that every task adds up before anything is shuffled, the number of
vectors and the sum of each dimension (exact), then the covariance of the vectors
less their means; centred first, so nothing cancels. What reaches the driver is bounded by
the square of the dimension, whatever the number of vectors.

The components of the covariance V are found on intervals of its spectrum:

slices   The number of eigenvalues above a value is the number of positive ones in V less
         that value (Sylvester's law of inertia, counted by a symmetric factorization
         with 1 x 1 and 2 x 2 pivots). Bisection by these counts cuts the spectrum, from its upper end,
         into intervals of few eigenvalues whose ends are away from any.
filter   For an interval, solves with the complex shifted covariance at the nodes of a
         quadrature on a circle around it, applied to a block of vectors, project
         the block on the interval's eigenvectors.
extract  Rayleigh-Ritz on the projected block gives eigenvalues and vectors; the block
         passes through the filter again until all residuals are at rounding level.
verify   The eigenvalues found in an interval must be as many as the inertia counts say;
         else the block is made larger, and in the end the run fails rather than miss one.

A third pass measures the covariance of the whitened vectors; the fourth writes them.

Defined results: null vectors and those with a null or non-finite entry are dropped;
vectors of another length than the most frequent one (ties: the greater) cannot be
in one covariance and are dropped too; entries so large that x would pass 2^45 count
as if it were; a deviation beyond a long is null; directions without variance
(up to rounding) have no component, so fewer than 32 rows per vector, or none, may come out;
empty tables give none; repeated rows count each; null ids stay; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kgspark.storage import Scratch

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000  # fixed values of x
LARGEST = 1 << 45
MOST = 8  # eigenvalues of an interval
NODES = 8  # of the quadrature on the upper half of the circle
PASSES = 60
ROUNDING = float(np.finfo(float).eps)


# -------------------------------------------------------- spectrum of a matrix

def above(matrix: np.ndarray, value: float) -> int:
    """Number of eigenvalues greater than ``value``: the positive inertia of the shifted matrix."""
    a = matrix - value * np.eye(len(matrix))
    positive = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.diagonal(size)
        p = int(np.argmax(diagonal))
        r, s = divmod(int(np.argmax(size - np.diag(diagonal))), len(a))
        if diagonal[p] == 0 and size[r, s] == 0:
            break
        if diagonal[p] >= 0.64 * size[r, s] or r == s:
            last, positive = [p], positive + int(a[p, p] > 0)
        else:  # a 2 x 2 pivot has an eigenvalue of each sign
            last, positive = [r, s], positive + 1
        rest = np.setdiff1d(np.arange(len(a)), last)
        side = a[np.ix_(rest, last)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(last, last)], side.T)
    return positive


def slices(matrix: np.ndarray, wanted: int, low: float, high: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues in them) from the upper end, until ``wanted`` are in them.

    An interval is halved, or cut near its half, where no eigenvalue is close; one that
    cannot be cut so holds a cluster and stays whole.
    """
    out, found = [], 0
    open_ = [(low, high, above(matrix, low), 0)]
    while open_ and found < wanted:
        a, b, n_a, n_b = open_.pop()
        if n_a == n_b:
            continue
        if n_a - n_b > MOST or (b - a) > 0.25 * high:
            margin = (b - a) * 1e-3
            for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.2, 0.8):
                cut = a + part * (b - a)
                n = above(matrix, cut)
                if margin > 64 * ROUNDING * high and above(matrix, cut - margin) == n == above(matrix, cut + margin):
                    open_ += [(a, cut, n_a, n), (cut, b, n, n_b)]
                    break
            else:
                out.append((a, b, n_a - n_b))
                found += n_a - n_b
            continue
        out.append((a, b, n_a - n_b))
        found += n_a - n_b
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their vectors."""
    dim, centre, radius = len(matrix), (low + high) / 2, (high - low) / 2
    # The filter falls off outside of the circle; the block covers what lies close to it.
    size = min(dim, above(matrix, centre - 2 * radius) - above(matrix, centre + 2 * radius) + 4)
    angles = np.pi * (2 * np.arange(NODES) + 1) / (2 * NODES)
    weights = radius * np.exp(1j * angles) / NODES
    shifted = [(centre + radius * np.exp(1j * t)) * np.eye(dim) - matrix for t in angles]
    norm = np.linalg.norm(matrix, 2)
    random = np.random.default_rng(0)
    while True:
        block = random.standard_normal((dim, size))
        best = np.inf
        for _ in range(PASSES):
            filtered = sum((w * np.linalg.solve(z, block.astype(complex))).real for w, z in zip(weights, shifted))
            basis, _ = np.linalg.qr(filtered)
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            inside = (values > low) & (values <= high)
            rest = np.linalg.norm(matrix @ block - block * values, axis=0)[inside].max(initial=0.0)
            if inside.sum() == count and rest <= 8 * dim * ROUNDING * norm:
                # Go on while passes still help, so that vectors are as good as rounding allows.
                if rest >= best / 2:
                    return values[inside], block[:, inside]
                best = rest
        if size == dim:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, not all of them found")
        size = min(dim, 2 * size)


def components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit vectors as columns; none without variance."""
    dim = len(matrix)
    scale = float(np.abs(matrix).sum(1).max(initial=0.0))  # no eigenvalue is greater
    if not scale > 0:
        return np.zeros(0), np.zeros((dim, 0))
    low, high = 16 * dim * ROUNDING * scale, scale * 1.001
    wanted = min(wanted, above(matrix, low))
    parts = [feast(matrix, a, b, n) for a, b, n in slices(matrix, wanted, low, high)]
    if not parts:
        return np.zeros(0), np.zeros((dim, 0))
    # Vectors of neighbouring intervals are made orthogonal to rounding by one more extraction.
    basis, _ = np.linalg.qr(np.concatenate([x for _, x in parts], axis=1))
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:wanted]
    return values[order], basis @ turn[:, order]


# -------------------------------------------------------------------- the job

@dataclass(frozen=True)
class Whitening:
    """What is fitted: the vectors' number, the sums per dimension, the greatest x, values, vectors, trace."""

    n: int
    sums: tuple[int, ...]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python's numbers where machine numbers do not suffice."""
        if 2 * self.n * self.largest < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that count."""
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))  # noqa: E731  NaN is the greatest
    whole = vectors.select("vec_id", "embedding").where(
        F.col("embedding").isNotNull() & F.forall("embedding", entry)
    )
    size = whole.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = size.orderBy(F.desc("n"), F.desc("dim")).first()
    return whole.where(F.size("embedding") == (top["dim"] if top else 0))


def _x(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers of a batch's vectors, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    steps = np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST - OFFSET)
    return steps.astype(np.int64).reshape(len(column), -1) + OFFSET


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), _x(part.column(1))


def _sums(vectors: DataFrame) -> tuple[int, tuple[int, ...], int]:
    def add(batches):
        for _, x in _batches(batches):
            dim = x.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x))), pa.array(x.sum(0)),
                pa.array(np.abs(x).max(0)),
            ], names=["place", "n", "total", "largest"])

    parts = vectors.mapInArrow(add, "place int, n bigint, total bigint, largest bigint")
    rows = parts.groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("largest").alias("largest")
    ).orderBy("place").collect()
    if not rows:
        return 0, (), 0
    return rows[0]["n"], tuple(int(r["total"]) for r in rows), max(r["largest"] for r in rows)


def _products(vectors: DataFrame, of_batch, size: int) -> np.ndarray:
    """Sum over all vectors of y y^T, where ``of_batch`` gives the y of a batch of x.

    Tasks send one row per pair of places on and below the diagonal; the sums are Spark's.
    """
    lower = np.tril_indices(size)

    def add(batches):
        total = np.zeros((size, size))
        for _, x in _batches(batches):
            y = of_batch(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([
            pa.array(lower[0].astype(np.int32)), pa.array(lower[1].astype(np.int32)), pa.array(total[lower])
        ], names=["i", "j", "total"])

    parts = vectors.mapInArrow(add, "i int, j int, total double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"]
    return out


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Whitening:
    """The whitening of a table of usable vectors."""
    n, sums, largest = _sums(vectors)
    dim = len(sums)
    start = Whitening(n, sums, largest, np.zeros(0), np.zeros((dim, 0)), 0.0)
    if n < 2:
        return start
    covariance = _products(vectors, start.centred, dim) / n
    values, found = components(covariance, wanted)
    return Whitening(n, sums, largest, values, found, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    k = len(fitted.values)
    # A column of ones gives the means, which rounding leaves close to zero.
    with_one = lambda x: np.column_stack([fitted.whitened(x), np.ones(len(x))])
    sums = _products(vectors, with_one, k + 1) / fitted.n
    mean = sums[:k, k]
    return float(np.abs(sums[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    used = usable(vectors)
    fitted = fit(used, wanted)
    k = len(fitted.values)
    if not k:
        return used.sparkSession.createDataFrame([], schema)
    error = identity_error(used, fitted)
    explained = fitted.values / fitted.trace

    def rows(batches):
        for ids, x in _batches(batches):
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fitted.n)), _repeat(_squares(fitted.deviations(x)), k),
                pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return used.mapInArrow(rows, schema)


def _squares(deviations: np.ndarray) -> pa.Array:
    """Sums of squares of rows, exact; null beyond a long."""
    largest = max(abs(int(deviations.max())), abs(int(deviations.min())))
    if deviations.shape[1] * largest * largest < 1 << 62:
        return pa.array((deviations * deviations).sum(1).astype(np.int64))
    exact = (deviations.astype(object) ** 2).sum(1)
    return pa.array([int(d) if d < 1 << 63 else None for d in exact], pa.int64())


def _repeat(values: pa.Array, k: int) -> pa.Array:
    return values.take(pa.array(np.repeat(np.arange(len(values)), k)))
