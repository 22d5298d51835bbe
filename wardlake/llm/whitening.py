"""Whitening of embeddings along their leading principal components.

Entries are made integers (``floor(scale * c)``), each distinct vector is fitted once, and
the covariance is summed by tasks over centred vectors. The centre is held as an integer
part and a rest, so that centring loses nothing however far the vectors lie from zero. The
covariance, whose size is that of the dimension squared, goes to the driver: Householder
reflections make it tridiagonal, Sturm counts bisect the leading eigenvalues, inverse
iteration finds their vectors, reorthogonalised within clusters of near eigenvalues. Mean
and components, a few vectors, go to every task for the projection.

Distinct vectors are reduced within tasks before they are shuffled; a vector that a third
of all rows share costs each task one row. What comes to the driver is sums: one per
dimension, and one per pair of dimensions.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left
out; a shorter vector counts as 0 where longer ones go on; an empty vector is all zeros;
repeated rows are projected each; products beyond a long become the nearest long, a
deviation beyond a long is null; components without variance (eigenvalue at most 1e-14 of
the trace) are not returned, so one distinct vector alone gives no rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.session import written

SCALE = 256
COMPONENTS = 4
#: Vectors that a task multiplies at once.
BLOCK_ROWS = 8_192
_LONG = 1 << 63


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit normals of the Householder reflections that led there."""
    a = np.array(matrix, np.float64)
    size = len(a)
    normals = []
    for k in range(size - 2):
        column = a[k + 1 :, k]
        length = np.linalg.norm(column)
        normal = column.copy()
        normal[0] += math.copysign(length, column[0])
        scale = np.linalg.norm(normal)
        if length == 0 or scale == 0:
            normals.append(np.zeros_like(normal))
            continue
        normal /= scale
        normals.append(normal)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(length, column[0] if column[0] else normal[0])
        rest = a[k + 1 :, k + 1 :]
        image = rest @ normal
        image -= (normal @ image) * normal
        rest -= 2 * (np.outer(normal, image) + np.outer(image, normal))
    return np.diag(a).copy(), np.diag(a, 1).copy(), normals


def below(diagonal: np.ndarray, off: np.ndarray, value: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are less than ``value`` (signs of the Sturm sequence)."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    count, pivot = 0, 1.0
    squares = [0.0, *(off * off).tolist()]
    for d, square in zip(diagonal.tolist(), squares, strict=True):
        pivot = d - value - square / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, many: int) -> list[float]:
    """The largest eigenvalues, falling, each bisected until the interval can't be halved."""
    size = len(diagonal)
    reach = np.zeros(size)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    least, most = float((diagonal - reach).min()), float((diagonal + reach).max())
    margin = 4 * np.finfo(np.float64).eps * max(abs(least), abs(most)) + np.finfo(np.float64).tiny
    least, most = least - margin, most + margin
    values = []
    for k in range(min(many, size)):
        low, high = least, values[-1] + margin if values else most
        while low < (middle := low + (high - low) / 2) < high:
            if below(diagonal, off, middle) >= size - k:
                high = middle
            else:
                low = middle
        values.append(high)
    return values


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; pivots of 0 become tiny."""
    size = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    lower, y = off.tolist(), right.tolist()
    for i in range(size - 1):
        if abs(lower[i]) > abs(main[i]):
            factor = main[i] / lower[i]
            main[i], upper[i], second[i], main[i + 1], upper[i + 1] = (
                lower[i], main[i + 1], upper[i + 1], upper[i] - factor * main[i + 1], -factor * upper[i + 1],
            )
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = lower[i] / main[i]
            main[i + 1] -= factor * upper[i]
            y[i + 1] -= factor * y[i]
    for i in range(size - 1, -1, -1):
        value = y[i]
        if i + 1 < size:
            value -= upper[i] * y[i + 1]
        if i + 2 < size:
            value -= second[i] * y[i + 2]
        y[i] = value / (main[i] if abs(main[i]) >= tiny else tiny)
    out = np.array(y)
    return out / np.abs(out).max()


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """A unit eigenvector (row) for each of the falling ``values``, orthogonal within clusters."""
    size = len(diagonal)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(off).max()) if size > 1 else 0.0, np.finfo(np.float64).tiny)
    eps = np.finfo(np.float64).eps
    random = np.random.default_rng(0)
    out = np.zeros((len(values), size))
    cluster, shift = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        # equal shifts would find equal vectors
        shift = value if k == cluster or shift - value > 10 * eps * norm else shift - 10 * eps * norm
        vector = random.normal(size=size)
        for _ in range(5):
            vector = _solved(diagonal, off, shift, vector, eps * norm)
            for _ in range(2):
                vector -= out[cluster:k].T @ (out[cluster:k] @ vector)
            vector /= np.linalg.norm(vector)
        out[k] = vector
    return out


def leading_components(covariance: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit eigenvectors as rows."""
    diagonal, off, normals = tridiagonal(covariance)
    values = leading_values(diagonal, off, many)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(normals) - 1, -1, -1):
        part = vectors[:, k + 1 :]
        part -= 2 * np.outer(part @ normals[k], normals[k])
    return np.array(values), vectors


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors fitted; their mean is ``floor`` + ``rest`` / n; ``values`` and ``vectors`` of the covariance."""

    n: int
    floor: tuple[int, ...]
    rest: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def size(self) -> int:
        return len(self.floor)


def _integers(column: pa.Array, size: int) -> np.ndarray:
    """Lists of longs as rows of a matrix; all have ``size`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _from_floor(x: np.ndarray, floor: tuple[int, ...]) -> np.ndarray:
    """x - floor, in longs where that can't overflow, else in integers of any size."""
    wide = x.size and (int(x.max()) >= _LONG // 2 or int(x.min()) <= -_LONG // 2)
    return x.astype(object) - np.array(floor, object) if wide else x - np.array(floor, np.int64)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _from_floor(x, model.floor).astype(np.float64) - np.array([r / model.n for r in model.rest])


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; None beyond a long."""
    off, rest = _from_floor(x, model.floor), np.array(model.rest, object)
    most = model.n * (int(abs(off).max()) + 1) if off.size else 0
    if off.dtype != object and most * most * max(1, model.size) < _LONG:
        return (((off * model.n - rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
    sums = ((off.astype(object) * model.n - rest) ** 2).sum(axis=1).tolist()
    return [s if s < _LONG else None for s in sums]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``vec_id`` and ``x`` (array of longs, all of one size) of every row that takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0  # one number
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))))
    return rows.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))).alias("x"))


def _summed(fit: DataFrame, size: int, block) -> dict[int, float]:
    """The sums, by place, of the vectors that ``block`` makes of each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                made = block(_integers(batch.column("x").slice(at, BLOCK_ROWS), size))
                total = made if total is None else total + made
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["place", "value"])

    sums = fit.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    return {r["place"]: r["value"] for r in sums.collect()}  # as many as pairs of dimensions


def _mean(fit: DataFrame, size: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, rows = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for batch in batches:
            x = _integers(batch.column("x"), size)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            rows += len(x)
        places = pa.array(np.arange(size), pa.int32())
        columns = [places, pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(np.full(size, rows), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["place", "high", "low", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.select("x").mapInArrow(run, "place int, high long, low long, n long")
    sums = parts.groupBy("place").agg(exact("high"), exact("low"), exact("n")).orderBy("place").collect()  # one per dimension
    n = int(sums[0]["n"])
    pairs = [divmod((int(r["high"]) << 32) + int(r["low"]), n) for r in sums]
    return n, tuple(q for q, _ in pairs), tuple(r for _, r in pairs)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of distinct integer vectors ``x``; None without rows or entries."""
    first = fit.select(F.size("x").alias("d")).first()
    size = first["d"] if first else 0
    if not size:
        return None
    n, floor, rest = _mean(fit, size)
    centre = Whitening(n, floor, rest, np.zeros(0), np.zeros((0, size)), np.zeros(0))

    def products(x: np.ndarray) -> np.ndarray:
        c = _centred(x, centre)
        return (c.T @ c).ravel()

    sums = _summed(fit, size, products)
    covariance = np.array([sums[k] for k in range(size * size)]).reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, vectors = leading_components(covariance, components)
    real = values > 1e-14 * trace
    values, vectors = values[real], vectors[real]
    return Whitening(n, floor, rest, values, vectors, values / trace if trace else values)


def whiten(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model) @ model.vectors.T / np.sqrt(model.values)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry, without sign, of the whitened fit rows' covariance minus the identity."""
    many = len(model.values)
    sums = _summed(fit, model.size, lambda x: whiten(x, model).sum(axis=0))
    mean = np.array([sums[k] for k in range(many)]) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = whiten(x, model) - mean
        return (w.T @ w).ravel()

    sums = _summed(fit, model.size, products)
    covariance = np.array([sums[k] for k in range(many * many)]).reshape(many, many) / model.n
    return float(np.abs(covariance - np.eye(many)).max())


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (one entry per component) of every row of integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _integers(part.column("x"), model.size)
                columns = [part.column("vec_id"), pa.array(_deviations(x, model), pa.int64()), pa.array(list(whiten(x, model)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector and component (the columns of SCHEMA)."""
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    out = project(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(identity_error(fit, model)).alias("identity_error"),
    )
