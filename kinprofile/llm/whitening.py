"""Whitening of embeddings with a contour-integration eigensolver.

1. Tasks bring entries to integers and keep each distinct vector once (the fit list); sums and the covariance are partial
   sums of every task, so the driver sees ``d`` numbers and one ``d x d`` matrix, whatever the number of rows.
2. The largest eigenvalues are cut into slices of the real line by inertia counts: the number of eigenvalues below ``s`` is
   the number of negative pivots of a symmetric factorisation of ``V - s I`` (Sylvester).
3. In every slice a subspace is projected by a quadrature of the resolvent along an ellipse around it - solves with
   ``z I - V`` at complex shifts - and Rayleigh-Ritz extracts the eigenpairs inside.  Rounds repeat until the residuals are
   at rounding level.  A slice is done when it holds exactly as many eigenvalues as its inertia counts say.
4. Rows are projected in tasks; the covariance of the whitened fit list is measured in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprofile.llm.common import Steps

NODES = 16  # quadrature nodes on the upper half of a contour
SLICE_MOST = 8  # eigenvalues a slice may hold, unless they are closer than rounding
ROUNDS = 30
OFFSET = 1_000_000
_EPS = np.finfo(np.float64).eps


def below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix below ``shift``: negative pivots of ``P (A - shift I) P' = L D L'``.

    Pivots are the Bunch-Parlett choice (1 x 1, or 2 x 2 where the diagonal is small), so that no growth hides a sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, negative = (1 + 17**0.5) / 8, 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), n)
        if max(diagonal[r], off[p, q]) == 0:
            return negative
        if diagonal[r] >= alpha * off[p, q]:
            chosen = [r]
            negative += int(a[r, r] < 0)
        else:  # an indefinite pair has one eigenvalue of each sign
            chosen = [p, q]
            negative += 1
        rest = np.setdiff1d(np.arange(n), chosen)
        b = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - b @ np.linalg.solve(a[np.ix_(chosen, chosen)], b.T)
        a = (a + a.T) / 2
    return negative


@dataclass
class Slice:
    low: float
    high: float
    count: int  # eigenvalues in [low, high) by inertia


def slices(matrix: np.ndarray, wanted: int) -> list[Slice]:
    """Disjoint slices, highest first, that hold the ``wanted`` largest eigenvalues (and those that fall in with them)."""
    n = len(matrix)
    reach = float(np.abs(matrix).sum(1).max())  # Gershgorin
    if reach == 0:
        return []
    top = reach * (1 + 1e-12) + np.finfo(float).tiny
    done: list[Slice] = []
    todo = [(-top, top, 0, n)]  # low, high, eigenvalues below each
    held = 0
    while todo and held < wanted:
        low, high, a, b = todo.pop()
        if a == b:
            continue
        if b - a <= SLICE_MOST or high - low <= 64 * _EPS * reach:
            # Room around the slice, so that its contour does not pass through an eigenvalue next to it.
            done.append(Slice(low, high, b - a))
            held += b - a
            continue
        middle = (low + high) / 2
        m = below(matrix, middle)
        todo += [(low, middle, a, m), (middle, high, m, b)]
    return done


def eigenpairs(matrix: np.ndarray, part: Slice, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in the slice and orthonormal vectors, by filtered subspace iteration."""
    n = len(matrix)
    scale = float(np.abs(matrix).sum(1).max())
    centre, radius = (part.low + part.high) / 2, max((part.high - part.low) / 2, 64 * _EPS * scale)
    size = min(n, part.count + max(4, part.count // 2))
    x, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - x)  # upper half circle; the lower one is its conjugate
    block = np.random.default_rng(seed).normal(size=(n, size))
    best, values, vectors = np.inf, np.zeros(0), np.zeros((n, 0))
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for theta, w in zip(angle, weight):
            z = centre + radius * np.exp(1j * theta)
            solved = np.linalg.solve(z * np.eye(n) - matrix, block.astype(complex))
            projected += w / 2 * (radius * np.exp(1j * theta) * solved).real
        basis, triangle = np.linalg.qr(projected)
        for _ in range(2):  # rounding of nearly dependent columns
            basis, _ = np.linalg.qr(basis)
        found, turn = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz on the small subspace
        ritz = basis @ turn
        # The filter leaves the slice's own components at size one, all others smaller: the count picks them.
        inside = np.sort(np.argsort(np.maximum(np.abs(found - centre) - radius, 0.0), kind="stable")[: part.count])
        values, vectors = found[inside], ritz[:, inside]
        error = float(np.abs(matrix @ vectors - vectors * values).max()) if len(inside) else 0.0
        if error <= 8 * _EPS * scale or (error <= 1e-12 * scale and error >= best / 2):
            break
        best, block = min(best, error), ritz
    room = 1e-9 * scale
    if len(values) < part.count or ((values < part.low - room) | (values > part.high + room)).any():
        raise ArithmeticError("a slice holds fewer eigenvalues than its inertia counts")
    return values, vectors


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit vectors as columns; none is missing by the inertia counts."""
    pairs = [eigenpairs(matrix, s) for s in slices(matrix, min(wanted, len(matrix)))]
    if not pairs:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values, vectors = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs], 1)
    # Slices meet in a common basis: one Rayleigh-Ritz step over all of them makes the vectors orthogonal across slices.
    basis, _ = np.linalg.qr(vectors)
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (basis @ turn)[:, order]


def _whole(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows ``(id, x)`` with integer entries as little-endian int64 bytes; unusable vectors are dropped."""
    kind = np.float32 if "float" in dict(rows.dtypes)[vector] else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                ids, xs = [], []
                for own, values in zip(part.column("id").to_pylist(), part.column("vec")):
                    if not values.is_valid or values.values.null_count or not len(values.values):
                        continue
                    c = values.values.to_numpy(zero_copy_only=False).astype(kind).astype(np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(64 * c)
                    if np.isfinite(c).all() and (np.abs(x) < 2.0**62).all():
                        ids.append(own)
                        xs.append((x.astype("<i8") + OFFSET).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], ["id", "x"])

    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vec")).mapInArrow(run, "id long, x binary")


def _sums(lists: DataFrame, d: int, make) -> np.ndarray:
    """Sum over the fit list of ``make(rows)``, an array of fixed size: one row of partial sums per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            for at in range(0, rows.num_rows, 2000):
                own = make(_matrix(rows.column("x").slice(at, 2000), d))
                total = own if total is None else total + own
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array([v.item() for v in flat], pa.float64() if flat.dtype.kind == "f" else pa.int64())], ["at", "v"])

    sample = make(np.zeros((0, d), np.int64))
    kind = "double" if sample.dtype.kind == "f" else "long"
    parts = lists.select("x").mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(sample.size, sample.dtype)
    for r in parts:
        out[r["at"]] = r["v"]
    return out.reshape(sample.shape)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


@dataclass
class Whitener:
    """What a fit over ``n`` distinct vectors has found: exact sums, eigenvalues (falling), unit vectors as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors / np.sqrt(self.values)


def fit(lists: DataFrame, n: int, d: int, components: int) -> Whitener:
    """Fit on the distinct integer vectors ``(x binary)`` of length ``d``."""
    sums = _sums(lists, d, lambda x: x.sum(0))
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        c = x - mean
        return c.T @ c

    covariance = _sums(lists, d, products) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = largest(covariance, components)
    real = values > 64 * d * _EPS * max(float(np.abs(covariance).max()), 0.0)  # directions without spread have no component
    model = Whitener(n, sums, values[real], vectors[:, real], float(np.trace(covariance)))
    if len(model.values):

        def whitened(x: np.ndarray) -> np.ndarray:
            w = model.apply(x)
            return w.T @ w

        model.identity_error = float(np.abs(_sums(lists, d, whitened) / n - np.eye(len(model.values))).max())
    return model


SCORES = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(rows: DataFrame, model: Whitener, d: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    # Exact in machine integers only while no sum of squares can leave them; beyond that, in Python's.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r = len(m.values)
        for whole in batches:
            for at in range(0, whole.num_rows if r else 0, 2000):
                part = whole.slice(at, 2000)
                x = _matrix(part.column("x"), d)
                small = m.n * float(np.abs(x).max()) < 2.0**61 and np.abs(m.sums).max() < 2.0**61
                gap = m.n * x - m.sums if small else m.n * x.astype(object) - m.sums.astype(object)
                if small and d * float(np.abs(gap).max()) ** 2 < 2.0**62:
                    deviation = (gap * gap).sum(1)
                else:
                    deviation = np.array([v if v < 1 << 63 else None for v in (gap.astype(object) ** 2).sum(1)], object)
                white = m.apply(x)
                k = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(np.repeat(np.arange(k), r))), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), k)),
                     pa.array(np.full(k * r, m.n)), pa.array(np.repeat(deviation, r), pa.int64()), pa.array(white.ravel()),
                     pa.array(np.tile(m.values / m.trace, k)), pa.array(np.full(k * r, m.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "x").mapInArrow(run, SCORES)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)``, up to ``components`` for each vector.

    Vectors that are null or empty, or hold null or non-finite entries (or entries beyond 2**56), are dropped.  Entries
    become floor(64 c) + 1000000.  Vectors of different length are fitted apart, each length with its own ``n``.  Directions
    without spread (eigenvalue 0 within rounding) are no components: a table of one distinct vector gives no rows.  Equal
    eigenvalues may come in any basis.  ``deviation`` is exact; a value beyond a long is null.  Rows that repeat a key, and
    those with a null key, are projected as they are; equal vectors count once in the fit.  Other columns are ignored.
    """
    spark = rows.sparkSession
    steps = Steps(spark)
    whole = steps.write(_whole(rows, key, vector), "whole")
    lists = steps.write(whole.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "fit")
    out = spark.createDataFrame([], SCORES)
    for size in lists.groupBy(F.length("x").alias("bytes")).count().orderBy("bytes").collect():  # one row per length of vector
        d = size["bytes"] // 8
        model = fit(lists.where(F.length("x") == size["bytes"]), size["count"], d, components)
        out = out.union(_project(whole.where(F.length("x") == size["bytes"]), model, d))
    steps.drop(lists)
    return out
