"""Whitening of embeddings by contour integration (FEAST) on their covariance.

Sums and products run over all rows as exact integers, so the covariance does not depend on the order or number of tasks.
Its eigenvalues are cut into intervals by inertia counts; each interval is one Spark task: a quadrature of solves with the
complex shifted covariance projects a random block on the interval's eigenvectors, a Rayleigh-Ritz step extracts them, and
their number must equal the inertia count or the block grows. Only what follows the dimension (the covariance, the chosen
components) meets at the driver, nothing that follows the rows.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import bounded_batches

#: Integer scale and shift of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Eigenvalues that one contour encloses at most, ties aside; quadrature nodes on its upper half.
PER_CONTOUR, NODES = 4, 8
#: Entries beyond this (|x| of 2^62) have no exact long; such a table is an error.
LARGEST = 2.0**62


class Moments(NamedTuple):
    n: int
    sums: list[int]
    covariance: np.ndarray


class Components(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray  # one column a component
    trace: float


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows whose vector is whole and finite, entries as integers.

    Null vectors and those with null or non-finite entries go. The dimension is that of most rows (ties: the smaller);
    vectors of another length, and empty ones, go too. Null and repeated keys stay as they are.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("c"))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))))
    first = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    d = first[0].d if first else 0
    scaled = F.transform("c", lambda e: F.when(F.abs(e) * SCALE < LARGEST, F.floor(e * SCALE)).otherwise(F.raise_error("an entry is too large for an exact long").cast("long")) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size("c") == d).select("vec_id", scaled.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, emit) -> dict[int, int]:
    """Adds (slot, whole number) pairs of all tasks; `emit` turns a task's batches into a dict. One row a slot is collected."""

    def run(batches):
        total = emit(batches)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([Decimal(int(v)) for v in total.values()], pa.decimal128(38, 0))], ["slot", "v"])

    parts = rows.mapInArrow(run, "slot long, v decimal(38,0)")
    return {r.slot: int(r.v) for r in parts.groupBy("slot").agg(F.sum("v").alias("v")).collect()}


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers: in doubles where every partial sum is below 2**53, in Python integers otherwise."""
    top = int(np.abs(y).max(initial=0))
    step = max(1, 2**53 // max(1, top * top))
    if top * top < 2**53 and step >= min(len(y), 64):
        out = np.zeros((y.shape[1],) * 2, object)
        for at in range(0, len(y), step):
            part = y[at : at + step].astype(np.float64)
            out += (part.T @ part).astype(np.int64).astype(object)
        return out
    wide = y.astype(object)
    return wide.T @ wide


def moments(rows: DataFrame) -> Moments:
    """Row count, exact sums by dimension, and the covariance (divisor n), each entry rounded once."""

    def sums(batches):
        total: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                low = (x & 0xFFFF).sum(axis=0)
                high = (x >> 16).sum(axis=0)
                for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    total[i] = total.get(i, 0) + a + (b << 16)
                total[-1] = total.get(-1, 0) + batch.num_rows
        return total

    first = _summed(rows, sums)
    n = first.pop(-1, 0)
    if not n:
        return Moments(0, [], np.zeros((0, 0)))
    s = [first[i] for i in range(len(first))]
    middle, d = [v // n for v in s], len(s)

    def products(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                total += exact_products(_matrix(batch) - np.asarray(middle, np.int64))
        return {i * d + j: total[i, j] for i in range(d) for j in range(i, d) if total[i, j]}

    second = _summed(rows, products)
    rest = [v - n * m for v, m in zip(s, middle, strict=True)]  # sums of x - middle
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * second.get(i * d + j, 0) - rest[i] * rest[j]) / (n * n)
    return Moments(n, s, v)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u[0] += size if u[0] >= 0 else -size
        u /= np.linalg.norm(u)
        a[k + 1 :, :] -= 2 * np.outer(u, u @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Eigenvalues above a shift, by the signs of the pivots of the shifted matrix (Sylvester's law)."""

    def __init__(self, v: np.ndarray) -> None:
        self.diagonal, off = tridiagonal(v)
        self.squares = np.concatenate([[0.0], off**2])
        radius = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
        self.low, self.high = float((self.diagonal - radius).min()), float((self.diagonal + radius).max())
        self.diagonal, self.squares = self.diagonal.tolist(), self.squares.tolist()
        self.scale = max(abs(self.low), abs(self.high))
        self.tiny = float(np.finfo(float).tiny / np.finfo(float).eps)

    def above(self, shift: float) -> int:
        count, pivot, shift = 0, 1.0, float(shift)
        for a, b in zip(self.diagonal, self.squares, strict=True):
            pivot = a - shift - b / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count

    def located(self, k: int, width: float) -> tuple[float, float]:
        """An interval no wider than width that holds the k-th largest eigenvalue."""
        pad = 1e-9 * self.scale + self.tiny
        low, high = self.low - pad, self.high + pad
        while high - low > width:
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return low, high

    def cut_below(self, k: int, d: int) -> tuple[float, int]:
        """A shift in the gap below the k-th largest eigenvalue, or below those it ties with; and how many lie above."""
        while k < d:
            for part in (1e-4, 1e-8, 1e-12, 1e-14):
                upper, lower = self.located(k, part * self.scale)[0], self.located(k + 1, part * self.scale)[1]
                if upper > lower:
                    return (upper + lower) / 2, k
            k += 1
        return self.low - 1e-3 * self.scale, d


def contours(inertia: Inertia, d: int, most: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of disjoint intervals, from the top, that hold the `most` largest eigenvalues."""
    out, have, high = [], 0, inertia.located(1, 1e-6 * inertia.scale)[1]
    while have < min(most, d):
        low, k = inertia.cut_below(min(have + PER_CONTOUR, most, d), d)
        margin = 0.05 * (high - low) if not out else 0.0
        out.append((low, high + margin, k - have))
        have, high = k, low
    return out


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of v between low and high, falling, with unit eigenvectors; their number must be the inertia count."""
    d, norm = len(v), float(np.abs(v).sum(axis=0).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 - nodes))
    size = min(d, count + max(4, count))
    random = np.random.default_rng(20250101)
    while True:
        block, best = random.standard_normal((d, size)), (np.inf, None, None)
        for _ in range(40):
            projected = np.zeros_like(block)
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - v, block.astype(complex))
                projected += 0.5 * weight * (radius * turn * solved).real
            basis, sizes, _ = np.linalg.svd(projected, full_matrices=False)
            basis = basis[:, sizes > 1e-14 * sizes[0]]
            ritz, inner = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ inner
            inside = (ritz > low) & (ritz < high)
            left = np.linalg.norm(v @ block - block * ritz, axis=0)
            if inside.sum() == count:
                worst = left[inside].max(initial=0)
                if worst >= best[0] / 2 and best[0] <= 1e-12 * norm:
                    break  # as exact as doubles allow
                if worst < best[0]:
                    best = (worst, ritz[inside], block[:, inside])
        if best[0] <= 1e-11 * norm:
            order = np.argsort(-best[1])
            vectors = best[2][:, order]
            return best[1][order], vectors / np.linalg.norm(vectors, axis=0)
        if size == d:
            raise ArithmeticError(f"the contour over [{low}, {high}] does not yield its {count} eigenvalues")
        size = min(d, 2 * size)


def principal_components(spark, covariance: np.ndarray, most: int) -> Components:
    """The `most` largest eigenvalues above rounding, with their vectors: one task a contour.

    A direction without variance has no whitened form and is left out, so that fewer may come back. The covariance goes to
    the tasks whole: dimension squared doubles, whatever the number of rows.
    """
    d, trace = len(covariance), float(np.trace(covariance))
    if trace <= 0:
        return Components(np.zeros(0), np.zeros((d, 0)), trace)
    inertia = Inertia(covariance)
    floor = d * np.finfo(float).eps * inertia.scale * 8
    most = min(most, inertia.above(floor))
    shared = spark.sparkContext.broadcast(covariance)

    def run(batches):
        for batch in batches:
            for low, high, count in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "count")), strict=True):
                values, vectors = feast(shared.value, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], ["value", "vector"])

    cuts = contours(inertia, d, most)
    jobs = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts))
    found = sorted(jobs.mapInArrow(run, "value double, vector array<double>").collect(), key=lambda r: -r.value)[:most]
    shared.unpersist()
    return Components(np.array([r.value for r in found]), np.array([r.vector for r in found]).reshape(-1, d).T, trace)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    No row remaining, or no variance at all: no rows. Repeated rows count and return each time. A deviation that does not
    fit in a long is an error rather than a rounded number.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, key, vector)
    n, sums, covariance = moments(rows)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = principal_components(spark, covariance, components) if n else None
    if found is None or not len(found.values):
        return spark.createDataFrame([], kind)
    k = len(found.values)
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    axes = found.vectors / np.sqrt(found.values)

    def whitened(batch):
        return ((_matrix(batch) - middle) - rest) @ axes

    def outer(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = whitened(batch)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["slot", "v"])

    parts = {r.slot: r.v for r in rows.mapInArrow(outer, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()}
    total = np.array([parts[i] for i in range((k + 1) * k)]).reshape(k + 1, k)
    error = float(np.abs(total[:k] / n - np.outer(total[k], total[k]) / (n * n) - np.eye(k)).max())
    explained = found.values / found.trace
    whole_sums = np.array(sums, object)

    def deviations(x: np.ndarray) -> pa.Array:
        off = n * int(np.abs(x - middle).max(initial=0)) + n
        if off * off * x.shape[1] < 2**63:
            y = n * (x - middle) - np.array([s % n for s in sums], np.int64)
            return pa.array((y * y).sum(axis=1), pa.int64())
        return pa.array([int(v) for v in ((n * x.astype(object) - whole_sums) ** 2).sum(axis=1)], pa.int64())  # pyarrow raises on what does not fit

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if m:
                times = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations(_matrix(batch)).take(pa.array(times)), pa.array(whitened(batch).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, kind)
