"""Embedding whitening: exact sums, distributed centred covariance, eigenvectors by tridiagonalisation, broadcast projection.

Entries become integers on a grid, so sums and each row's deviation are exact. Covariance matrices are made in tasks, centred before
they are multiplied, and added in a tree; a task and the driver hold matrices of dimension squared, never vectors of all rows. The
driver brings the covariance to tridiagonal form by Householder reflections, finds the leading eigenvalues by bisection on Sturm counts,
and their vectors by inverse iteration, in which vectors of eigenvalues close to each other are made orthogonal to one another again.
Rows are then projected by the broadcast components; a pass over the projections measures how far their covariance is from the identity.

Cases: vectors that are null or hold null or non-finite entries go; so do those of another length than most vectors have (of two equally
frequent lengths the longer stays), and empty ones. Components without variance are not given, so equal vectors, or a single one, give no
rows. Repeated rows each count and each get their rows; a null id stays null; an empty table gives no rows; a deviation beyond a long's
range is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import lean, shared, table
from readloom.llm.trees import SCHEMA, tree_summed

#: Grid of the integers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000

#: Eigenvalues closer than this, relative to the matrix's norm, are one cluster.
CLOSE = 1e-3

#: Rows of vectors that one numpy step works on.
ROWS = 4096


# ---------------------------------------------------------------- leading eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections (unit vectors, null where there is nothing to reflect) of a symmetric matrix."""
    a, n, mirrors = np.array(a, float), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        x[0] += np.copysign(length, x[0])
        size = np.linalg.norm(x)
        mirrors.append(x / size if size else np.zeros_like(x))
        v = mirrors[-1]
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (p @ v) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each number."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    least = np.finfo(float).eps * max(1e-300, np.abs(off).max(initial=0.0)) + tiny
    n, q = np.zeros(len(at), int), np.ones(len(at))
    for d, e in zip(diagonal, [0.0, *off], strict=True):
        q = d - at - e * e / q
        q = np.where(np.abs(q) < least, -least, q)
        n += q < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    n = len(diagonal)
    reach = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    place = n - np.arange(k)  # eigenvalue k from above is that with place - 1 below it
    for _ in range(120):
        middle = low + (high - low) / 2
        over = below(diagonal, off, middle) >= place
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, b: np.ndarray, least: float) -> np.ndarray:
    """x of (T - value) x = b by elimination with row exchanges; pivots under `least` count as that."""
    n = len(diagonal)
    d, u, u2, b = diagonal - value, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        lower = off[i]
        if abs(lower) > abs(d[i]):
            d[i], u[i], u2[i], d1, u1, b0 = lower, d[i + 1], u[i + 1], d[i], u[i], b[i]
            b[i] = b[i + 1]
            m = d1 / lower
            d[i + 1], u[i + 1], b[i + 1] = u1 - m * u[i], -m * u2[i], b0 - m * b[i]
        else:
            if abs(d[i]) < least:
                d[i] = least
            m = lower / d[i]
            d[i + 1] -= m * u[i]
            b[i + 1] -= m * b[i]
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        pivot = d[i] if abs(d[i]) >= least else least
        x[i] = (b[i] - u[i] * x[i + 1] - u2[i] * x[i + 2]) / pivot
    return x[:n]


def leading_vectors(a: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n, k = len(a), min(k, len(a))
    size = float(np.abs(a).max(initial=0.0))
    if not k or not size:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, mirrors = tridiagonal(np.asarray(a, float) / size)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    rng, vectors, first = np.random.default_rng(seed), np.zeros((n, k)), 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLOSE * norm:
            first = i
        mates = vectors[:, first:i]
        x = rng.standard_normal(n)
        # eigenvalues of a cluster that coincide are moved apart by a rounding error, so their systems differ
        value = values[i] - (i - first) * 2 * np.finfo(float).eps * norm
        for _ in range(6):
            for _ in range(2):
                x -= mates @ (mates.T @ x)
            x /= np.linalg.norm(x)
            x = _solved(diagonal, off, value, x, np.finfo(float).eps * norm)
        for _ in range(2):
            x -= mates @ (mates.T @ x)
        vectors[:, i] = x / np.linalg.norm(x)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        vectors[j + 1 :] -= 2 * np.outer(v, v @ vectors[j + 1 :])
    return values * size, vectors


# ---------------------------------------------------------------- over all rows


def on_grid(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows with `column` as x, an array of longs; only those whose vector is whole and as long as most are. And that length."""
    clean = vectors.withColumn("x", F.col(column).cast("array<double>")).filter(
        "x is not null and size(x) > 0 and not exists(x, c -> c is null or isnan(c) or abs(c) = double('Infinity'))"
    )
    found = clean.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if found is None:
        return clean.withColumn("x", F.col("x").cast("array<bigint>")), 0
    grid = F.transform("x", lambda c: F.floor(c * float(SCALE)) + SHIFT)
    return clean.filter(F.size("x") == found["dim"]).withColumn("x", grid), found["dim"]


class Components:
    """n and exact sums of integer vectors x; trace of their covariance, its leading eigenvalues and unit eigenvectors as columns."""

    def __init__(self, dim: int, n: int, sums: list[int]):
        self.dim, self.n, self.sums = dim, n, sums
        self.values, self.vectors, self.trace = np.zeros(0), np.zeros((dim, 0)), 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as longs, or as whole numbers of any size where longs don't suffice."""
        most = max(map(abs, [*self.sums, int(np.abs(x).max(initial=0)) * self.n]), default=0)
        if most < 1 << 61:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and self.dim * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63:
            return (centred * centred).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in (sum(int(v) ** 2 for v in row) for row in centred)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.vectors / np.sqrt(self.values)


def _matrices(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for i in range(0, len(column), ROWS):
        yield column.slice(i, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for b in batches:
            for x in _matrices(b.column(0), dim):
                exact = x.sum(0) if int(np.abs(x).max(initial=0)) < 1 << 50 else x.astype(object).sum(0)
                total = [a + int(v) for a, v in zip(total, [*exact, len(x)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(map(str, total), pa.string())], ["at", "s"])

    found = rows.select("x").mapInArrow(run, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    exact = {r["at"]: int(r["s"]) for r in found}
    return exact.get(dim, 0), [exact.get(i, 0) for i in range(dim)]


def tree_sum_of(rows: DataFrame, dim: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors x of a matrix that `part` makes of some of them; tasks' matrices are added in a tree, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for x in _matrices(b.column(0), dim):
                total += part(x)
        blocks = pa.array(range(shape[0]), pa.int32())
        yield pa.RecordBatch.from_arrays([blocks, blocks, pa.array([r.tobytes() for r in total], pa.binary())], ["part", "block", "sums"])

    partials = rows.select("x").mapInArrow(run, SCHEMA).withColumn("part", F.spark_partition_id())
    out = np.zeros(shape)
    for r in tree_summed(partials, "f8").collect():
        out[r["block"]] = np.frombuffer(r["sums"])
    return out


def components_of(rows: DataFrame, dim: int, components: int = 32) -> Components:
    """Leading components of all vectors x of `rows`."""
    spark = rows.sparkSession
    out = Components(dim, *(summed(rows, dim) if dim else (0, [])))
    if out.n:
        value = shared(spark, out)

        def products(x: np.ndarray) -> np.ndarray:
            y = (value.value.centred(x) / value.value.n).astype(float)
            return y.T @ y

        cov = tree_sum_of(rows, dim, (dim, dim), products) / out.n
        out = Components(dim, out.n, out.sums)
        out.trace = float(np.trace(cov))
        values, vectors = leading_vectors((cov + cov.T) / 2, components)
        real = values > out.trace * np.finfo(float).eps * dim * 8
        out.values, out.vectors = values[real], vectors[:, real]
    return out


def identity_error(rows: DataFrame, found: Components) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(found.values)
    if not k:
        return 0.0
    value = shared(rows.sparkSession, found)
    mean = tree_sum_of(rows, found.dim, (1, k), lambda x: value.value.whitened(value.value.centred(x)).sum(0, keepdims=True)) / found.n

    def products(x: np.ndarray) -> np.ndarray:
        y = value.value.whitened(value.value.centred(x)) - mean
        return y.T @ y

    return float(np.abs(tree_sum_of(rows, found.dim, (k, k), products) / found.n - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 32) -> DataFrame:
    """Rows of `vectors` as (vec_id, component, n, deviation, whitened, explained, identity_error), one for each component."""
    spark = vectors.sparkSession
    rows, dim = on_grid(vectors.select("vec_id", F.col(column)), column)
    rows = rows.select("vec_id", "x")
    found = components_of(rows, dim, components)
    error, value = identity_error(rows, found), shared(spark, found)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = value.value
        k = len(m.values)
        for b in batches if k else ():
            for at, x in zip(range(0, b.num_rows, ROWS), _matrices(b.column(1), dim)):
                y = m.centred(x)
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    b.column(0).slice(at, ROWS).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n, np.int64)),
                    pa.array(m.deviation(y), pa.int64()).take(pa.array(each)), pa.array(m.whitened(y).ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    schema = rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
