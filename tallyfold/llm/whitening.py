"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The fit list holds each distinct integer vector once. The covariance is never formed: a pass over the fit list returns
V·Q = Xᵀ(XQ)/n of the centred vectors X for a block Q, one row per dimension. A polynomial recurrence over such passes
damps the unwanted part of the spectrum; then QR, a Rayleigh-Ritz step, and the residuals of the wanted pairs. This goes on
until every residual ‖Vq − eq‖ is at most ``TOLERANCE`` times the largest eigenvalue, which certifies the pairs.

What reaches the driver are blocks of dimensions × ``BLOCK`` numbers and one sum per dimension; the table stays distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import stored

SCALE = 256
COMPONENTS = 4
# Vectors that are iterated together; those beyond the wanted ones push the unwanted spectrum away.
BLOCK = 16
DEGREE = 8
TOLERANCE = 1e-12
MAX_ROUNDS = 200
SEED = 20


def integer_vector(vector: Column) -> Column:
    """floor(256 c) of each entry as long; null for a null vector or one with null or non-finite entries.

    An entry whose product is beyond the range of a long raises, as any cast out of range does.
    """
    entry = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(entry(c) * SCALE).cast("long")))


@dataclass
class Components:
    """Exact moments of the fit list and the certified leading pairs; columns of ``vectors`` are unit vectors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums]) if self.n else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def moments(fit: DataFrame) -> tuple[int, list[int], int]:
    """Exact (rows, sum of each dimension, sum of all squares) of the column x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, None, 0
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not x.size:
                n += len(x)
                continue
            most = int(np.abs(x).max())
            wide = x.astype(object) if most * max(most, 1) * x.size >= 1 << 62 or most < 0 else x
            own = wide.sum(axis=0)
            sums = own.astype(object) if sums is None else sums + own.astype(object)
            squares += int((wide * wide).sum())
            n += len(x)
        values = [n, squares, *(sums if sums is not None else [])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-2, len(values) - 2), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
            ["at", "v"],
        )

    rows = fit.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    found = {r["at"]: int(r["v"]) for r in rows}
    sums = [found[k] for k in sorted(found) if k >= 0]
    return found.get(-2, 0), sums, found.get(-1, 0)


def covariance_pass(fit: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the fit list's covariance and a block, by one pass over the vectors centred first."""
    d = len(mean)

    def product(block: np.ndarray) -> np.ndarray:
        k = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, k))
            for batch in batches:
                x = _matrix(batch.column("x"))
                if len(x):
                    x = x - mean
                    total += x.T @ (x @ block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), *(pa.array(total[:, j]) for j in range(k))],
                ["at", *(f"q{j}" for j in range(k))],
            )

        parts = fit.select("x").mapInArrow(run, "at int, " + ", ".join(f"q{j} double" for j in range(k)))
        out = np.zeros((d, k))
        for row in parts.groupBy("at").agg(*[F.sum(f"q{j}") for j in range(k)]).collect():
            out[row[0]] = row[1:]
        return out / n

    return product


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in an orthonormal basis with its image V·basis: falling values, vectors, their images."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], basis @ turn, image @ turn


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray],
    d: int,
    wanted: int,
    block: int = BLOCK,
    degree: int = DEGREE,
    tolerance: float = TOLERANCE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Eigenvalues, unit vectors, residuals and the number of passes, for the leading pairs of a symmetric product."""
    wanted, block = min(wanted, d), min(d, max(block, 2 * wanted))
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(q)

    start = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, block)))[0]
    image = times(start)
    low = 0.0
    if block < d:
        # A second block of the Krylov space tells where the unwanted spectrum begins.
        more = np.linalg.qr(image - start @ (start.T @ image))[0]
        more = np.linalg.qr(more - start @ (start.T @ more))[0][:, : d - block]
        both, images = np.hstack([start, more]), np.hstack([image, times(more)])
        values, vectors, moved = _ritz(both, images)
        least = np.linalg.norm(moved[:, -1] - values[-1] * vectors[:, -1])
        low = max(0.0, values[-1] - least)
        values, vectors, moved = values[:block], vectors[:, :block], moved[:, :block]
    else:
        values, vectors, moved = _ritz(start, image)
    residuals = np.linalg.norm(moved - vectors * values, axis=0)
    for _ in range(MAX_ROUNDS):
        most = max(abs(values[0]), 0.0)
        if (residuals[:wanted] <= tolerance * most).all() or block == d:
            return values[:wanted], vectors[:, :wanted], residuals[:wanted], passes
        high = max(values[-1], low)
        if values[wanted - 1] <= high or high <= low:
            low = 0.0
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-300)
        scale = half / (values[0] - centre)
        before, now, sigma = vectors, (moved - centre * vectors) * (scale / half), scale
        for _ in range(degree - 1):
            step = 1.0 / (2.0 / scale - sigma)
            before, now = now, (times(now) - centre * now) * (2.0 * step / half) - before * (sigma * step)
            sigma = step
        basis = np.linalg.qr(now)[0]
        values, vectors, moved = _ritz(basis, times(basis))
        residuals = np.linalg.norm(moved - vectors * values, axis=0)
    raise RuntimeError(f"not certified after {passes} passes: residuals {residuals[:wanted]}")


def fit_components(fit: DataFrame, components: int = COMPONENTS, **options) -> Components:
    """Leading pairs of the covariance of a table with one distinct integer vector x in each row."""
    n, sums, squares = moments(fit)
    d = len(sums)
    if not n or not d:
        return Components(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)
    trace = float((n * squares - sum(s * s for s in sums)) / n / n) if n * squares != sum(s * s for s in sums) else 0.0
    if not trace:
        return Components(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)
    mean = np.array([float(s) / n for s in sums])
    values, vectors, residuals, passes = leading_pairs(covariance_pass(fit, mean, n), d, components, **options)
    # Directions without variance cannot be whitened.
    real = values > 1e-12 * trace
    vectors = vectors[:, real]
    # Of the two unit vectors the one whose largest entry is positive.
    if vectors.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return Components(n, sums, trace, values[real], vectors, residuals[real], passes)


def _identity_error(fit: DataFrame, found: Components) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, d = len(found.values), len(found.sums)
    if not k:
        return 0.0
    mean, turn = found.mean, found.vectors / np.sqrt(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                w = (x.reshape(-1, d) - mean) @ turn
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        at = [(i, j) for i in range(k + 1) for j in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array(total.ravel())],
            ["i", "j", "v"],
        )

    parts = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k))
    for i, j, v in parts.collect():
        total[i, j] = v / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    **options,
) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of every row with a usable vector.

    A row is dropped when its vector is null or has null or non-finite entries. Repeated rows are all returned and count once in
    the fit. All usable vectors must have one length, else ``ValueError``. Without usable rows, with vectors of no entries, or
    with a single distinct vector there are no components, hence no rows; components without variance are left out. Equal
    eigenvalues come in an arbitrary order that is the same for all rows. Other columns are not read, whatever their
    names. ``deviation`` is exact; beyond a long it raises. The work of the fit is bounded by passes over the distinct
    vectors; the driver holds dimensions × block numbers.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("_key"), integer_vector(F.col(f"`{vector}`")).alias("x"))
    rows = rows.where(F.col("x").isNotNull())
    # Distinct vectors are combined before they are shuffled; every pass reads the same written table.
    fit = stored(rows.select("x").distinct(), "fit-list")
    lengths = [r[0] for r in fit.groupBy(F.size("x")).count().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths, {lengths[0]} and {lengths[1]} among them")
    found = fit_components(fit, components, **options)
    error = _identity_error(fit, found)
    n, sums, mean, k = found.n, found.sums, found.mean, len(found.values)
    turn = found.vectors / np.sqrt(found.values) if k else found.vectors
    explained = found.values / found.trace if k else found.values
    kind = rows.schema["_key"].dataType.simpleString()
    most_sum = max(map(abs, sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not len(batch):
                continue
            x = _matrix(batch.column("x"))
            bound = n * int(np.abs(x).max()) + most_sum
            # In 64 bits where it fits, else in whole numbers of any size.
            away = n * x - np.array(sums) if bound * bound * len(sums) < 1 << 63 else n * x.astype(object) - np.array(sums, object)
            deviation = (away * away).sum(axis=1).tolist()
            white = (x - mean) @ turn
            index = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(index)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(index), n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(index)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(index), error)),
                ],
                ["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"_key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
