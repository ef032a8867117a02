"""Whitening of embeddings: an exact distributed scatter, cyclic Jacobi rotations on the driver, projections in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

SCALE = 256
_MOST = float((1 << 31) // SCALE)
_EXACT = 1 << 53  # whole numbers below it are exact as doubles
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening(NamedTuple):
    """n distinct vectors with `sums` of each dimension; `values` (falling) and unit `vectors` (columns) of their covariance,
    and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self, components: int) -> np.ndarray:
        """What centred vectors are multiplied with: a column for each of the first components."""
        return self.vectors[:, :components] / np.sqrt(self.values[:components])

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def jacobi(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix.

    A sweep meets every pair of dimensions once, in rounds of pairs that share none, so that a round's rotations are one
    step. It ends when each off-diagonal is nothing beside the geometric mean of its two diagonals, a test that keeps small
    eigenvalues accurate relative to themselves."""
    a = (matrix + matrix.T) / 2
    d = len(a)
    q, order, half = np.eye(d), np.arange(d + d % 2), (d + 1) // 2
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(order) - 1):
            one, other = order[:half], order[half:][::-1]
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
            i, j = np.minimum(one, other), np.maximum(one, other)
            i, j = i[j < d], j[j < d]
            some = np.abs(a[i, j]) > np.finfo(float).eps * np.sqrt(np.abs(a[i, i] * a[j, j]))
            if not some.any():
                continue
            turned, i, j = True, i[some], j[some]
            with np.errstate(over="ignore"):
                slope = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(1, slope))
            c = 1 / np.hypot(1, t)
            s = t * c
            x, y = a[:, i].copy(), a[:, j].copy()
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            x, y = a[i].copy(), a[j].copy()
            a[i], a[j] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[i, j] = a[j, i] = 0
            x, y = q[:, i].copy(), q[:, j].copy()
            q[:, i], q[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    falling = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[falling], q[:, falling]


def quantized(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, x (array of int, floor(256 * entry)) of the usable rows: vectors that are null or hold null, NaN or infinite
    entries go, and so do those with an entry of 2 ** 23 or more in size (whose deviations don't fit a long)."""
    usable = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < _MOST))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    return vectors.where(usable).select(F.col(key).alias("key"), x.alias("x"))


def _block(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, d)


def _totals(rows: DataFrame, values: str, of, keys: list[str]) -> list:
    """Sums, by keys, of what each task has summed: as many rows as there are keys, for any number of tasks."""
    each = rows.mapInArrow(of, ", ".join(f"{k} int" for k in keys) + f", v {values}")
    return each.groupBy(*keys).agg(F.sum("v").alias("v")).collect()


def _whole(entries: list[tuple[tuple[int, ...], int]], keys: list[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k, _ in entries], pa.int32()) for i in range(len(keys))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(v) for _, v in entries], pa.decimal128(38, 0))], names=[*keys, "v"])


def exact_products(z: np.ndarray) -> np.ndarray:
    """z.T @ z of whole numbers as Python integers: products of doubles over so few rows that none is rounded."""
    most = int(np.abs(z).max(initial=0)) ** 2
    if most >= _EXACT:
        z = z.astype(object)
        return z.T @ z
    total = np.zeros((z.shape[1], z.shape[1]), object)
    rows = max(1, _EXACT // max(1, most) - 1)
    for at in range(0, len(z), rows):
        part = z[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def fit(distinct: DataFrame, d: int) -> Whitening | None:
    """Of a table of distinct vectors x of d dimensions; None without any. The covariance is exact before it is rounded to
    doubles: tasks centre by the rounded mean and multiply whole numbers, and the driver takes what rounding left over off."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            n += batch.num_rows
            total = total + _block(batch, d).sum(axis=0).astype(object)
        yield _whole([((-1,), n), *(((i,), v) for i, v in enumerate(total.tolist()))], ["i"])

    found = {r["i"]: int(r["v"]) for r in _totals(distinct, "decimal(38,0)", sums, ["i"])}
    n = found.get(-1, 0)
    if n == 0 or d == 0:
        return None
    total = [found[i] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    whole_centre = np.array(centre, np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((d, d), object)
        for batch in batches:
            own = own + exact_products(_block(batch, d) - whole_centre)
        for i in range(d):
            yield _whole([((i, j), own[i, j]) for j in range(i, d)], ["i", "j"])

    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    covariance = np.zeros((d, d))
    for r in _totals(distinct, "decimal(38,0)", scatter, ["i", "j"]):
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * int(r["v"]) - rest[i] * rest[j]) / (n * n)
    values, vectors = jacobi(covariance)
    return Whitening(n, total, values, vectors, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    d, mean, matrix = len(model.sums), model.mean(), model.matrix(components)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((components, components))
        for batch in batches:
            y = (_block(batch, d) - mean) @ matrix
            own += y.T @ y
        i, j = np.indices(own.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(own.reshape(-1))], names=["i", "j", "v"])

    return max(abs(r["v"] / model.n - (r["i"] == r["j"])) for r in _totals(distinct, "double", products, ["i", "j"]))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of squares of n * x - sums, exact; None where one doesn't fit a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    kind = np.int64 if most * most * max(1, len(sums)) < 1 << 63 else object
    off = x.astype(kind) * n - np.array(sums, kind)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    The fit takes each distinct quantized vector once, however many rows hold it; repeated rows each get their rows, a null
    key goes through. Vectors of another length than the most frequent one (the longer of equals) go with the unusable ones
    (see quantized), as do empty ones. Components without variance, below rounding, have no rows, so an empty table, a single
    vector or equal vectors give none. Equal eigenvalues keep the order in which the rotations left them."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    rows = quantized(vectors, key, column)
    kind = vectors.schema[key].dataType.simpleString()
    distinct = written(rows.select("x").distinct(), "whitening")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    distinct = distinct.where(F.size("x") == d)
    model = fit(distinct, d)
    usable = 0 if model is None else int((model.values > max(model.values[0], 0.0) * d * np.finfo(float).eps).sum())
    k = min(components, usable)
    if model is None or k == 0:
        return spark.createDataFrame([], f"{key} {kind}, {_OUT}")
    error, mean, matrix = identity_error(distinct, model, k), model.mean(), model.matrix(k)
    explained = model.values[:k] / model.trace
    n, sums = model.n, model.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, many = _block(batch, d), batch.num_rows
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(many), k)))
            columns = [
                keys,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                pa.array(np.full(many * k, n, np.int64)),
                pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(((x - mean) @ matrix).reshape(-1)),
                pa.array(np.tile(explained, many)),
                pa.array(np.full(many * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(project, f"key {kind}, {_OUT}").withColumnRenamed("key", key)
