"""Whitening of embeddings by their principal components, from exact cross-products.

Components become integers.  Their cross-products are counted by bit-sliced scatter:
the bit planes of each dimension, shifted to begin at zero, are packed across rows into
words; the popcounts of the ANDs of any two planes, weighted by their powers of two, add
up to the exact sum of products.  Sums are centred as integers before the eigenvectors
are taken, so nothing is lost to cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.staging import stage

#: An entry c is the integer floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries of a larger size have no exact integer.
LARGEST = float(1 << 43)
COMPONENTS = 8
#: Rows whose bit planes are packed at once.
ROWS = 8192
#: A component whose share of the largest eigenvalue is smaller is rounding, not variance.
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n vectors with sums per dimension, falling eigenvalues, unit eigenvectors as columns, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: str | Column, n_dims: int) -> Column:
    """Is this a vector of so many entries, none of which is null or not finite?"""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce((F.size(v) == n_dims) & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST)), F.lit(False))


def dimensions(rows: DataFrame, vector: str = "embedding") -> int:
    """The commonest number of entries of the vectors without null or non-finite ones; of equally common ones the largest; 0 without vectors."""
    size = F.size(vector)
    counted = rows.where(usable(vector, size)).groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max(F.struct("n", "d")).alias("m")).first().m
    return most.d if most else 0


def integers(column: pa.Array, n_dims: int) -> np.ndarray:
    """The entries of a list column as floor(SCALE * c), rows x dimensions."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n_dims) * SCALE).astype(np.int64)


def scatter(y: np.ndarray) -> np.ndarray:
    """The exact sums of products of any two columns of ``y`` (rows x dimensions), as Python integers."""
    n, d = y.shape
    low = y.min(axis=0)
    shifted = (y - low).astype(np.uint64)
    bits = int(shifted.max()).bit_length()
    words = -(-n // 64)
    planes = np.zeros((d, bits, words * 8), np.uint8)
    for p in range(bits):
        packed = np.packbits((shifted >> np.uint64(p) & np.uint64(1)).astype(bool), axis=0)
        planes[:, p, : len(packed)] = packed.T
    flat = planes.reshape(d * bits, words * 8).view(np.uint64)
    counts = np.zeros((d * bits, d * bits), np.int64)
    for k in range(d * bits):
        counts[k, k:] = np.bitwise_count(flat[k] & flat[k:]).sum(axis=1, dtype=np.int64)
    counts = np.maximum(counts, counts.T).reshape(d, bits, d, bits)
    power = [1 << p for p in range(bits)]
    if 2 * bits + n.bit_length() < 63:
        weight = np.array(power, np.int64)
        products = np.einsum("ipjq,p,q->ij", counts, weight, weight).astype(object)
    else:
        weight = np.array(power, object)
        products = np.array([[sum(weight[p] * weight[q] * int(counts[i, p, j, q]) for p in range(bits) for q in range(bits)) for j in range(d)] for i in range(d)], object).reshape(d, d)
    low, sums = low.astype(object), shifted.sum(axis=0, dtype=np.uint64).astype(object)
    return products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def fit(rows: DataFrame, n_dims: int, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """Fit on all rows of ``rows``, whose vectors must be usable.

    A task sends one number for each two dimensions, split into two that add up without
    overflow; the sums are taken in Spark, and the driver gets dimensions squared numbers.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(n_dims, object), np.zeros((n_dims, n_dims), object)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                y = integers(batch.column(0).slice(i, ROWS), n_dims)
                n, sums, products = n + len(y), sums + y.sum(axis=0).astype(object), products + scatter(y)
        if n:
            i, j = np.triu_indices(n_dims)
            value = [n, *sums, *products[i, j]]
            at = [np.concatenate([[-1], np.arange(n_dims), i]), np.concatenate([[-1], np.full(n_dims, -1), j])]
            high = [int(v) >> 32 for v in value]
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(high, pa.int64()), pa.array([int(v) & 0xFFFFFFFF for v in value], pa.int64())], names=["i", "j", "high", "low"])

    parts = rows.select(vector).mapInArrow(add_up, "i int, j int, high long, low long")
    found = {(r.i, r.j): (int(r.high) << 32) + int(r.low) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    if not found:
        return Whitening(0, (0,) * n_dims, np.zeros(0), np.zeros((n_dims, 0)), 0.0)
    n = found[-1, -1]
    sums = [found[i, -1] for i in range(n_dims)]
    centred = np.zeros((n_dims, n_dims))
    for i in range(n_dims):
        for j in range(i, n_dims):
            centred[i, j] = centred[j, i] = (n * found[i, j] - sums[i] * sums[j]) / (n * n)  # of whole numbers: rounded once
    trace = sum(n * found[i, i] - sums[i] * sums[i] for i in range(n_dims)) / (n * n)
    values, vectors = np.linalg.eigh(centred)
    k = min(components, n_dims)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return Whitening(n, tuple(s + OFFSET * n for s in sums), np.where(values > NOTHING * max(values[0], 0.0), values, 0.0), np.ascontiguousarray(vectors), trace)


def projected(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Staged, per row: vec_id, deviation (exact), whitened (one value per component; null where there is no variance)."""
    n, d, k = model.n, len(model.sums), len(model.eigenvalues)
    sums = np.array([s - OFFSET * n for s in model.sums], object)
    live = model.eigenvalues > 0
    scale = model.vectors[:, live] / np.sqrt(model.eigenvalues[live])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                y = integers(part.column(1), d)
                most = max(abs(n * int(s) - int(t)) for of in (y.max(axis=0), y.min(axis=0)) for s, t in zip(of, sums, strict=True))
                exact = n * (y if most * most * d < 1 << 62 else y.astype(object)) - (sums.astype(np.int64) if most * most * d < 1 << 62 else sums)
                values = np.full((len(y), k), np.nan)
                values[:, live] = (exact.astype(np.float64) / n) @ scale
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel())))
                deviation = pa.array([str(x) for x in (exact * exact).sum(axis=1).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, whitened], names=["vec_id", "deviation", "whitened"])

    out = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(project, "vec_id long, deviation string, whitened array<double>")
    return stage(out.withColumn("deviation", F.col("deviation").cast("decimal(38, 0)")), "whitened")


def identity_error(found: DataFrame, k: int, value: str = "whitened") -> float:
    """The largest absolute entry of the values' covariance (centred first, divisor n) minus the identity."""
    if not k:
        return 0.0
    means = found.agg(*[F.avg(F.col(value)[i]).alias(f"m{i}") for i in range(k)]).first()
    of = lambda i: F.col(value)[i] - F.lit(means[i])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = found.agg(*[F.avg(of(i) * of(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((abs(c - (i == j)) for (i, j), c in zip(pairs, covariance, strict=True) if c is not None), default=0.0)


def whitened(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Defined cases: a vector that is null, has a null or non-finite entry or one beyond
    2**43, or has another number of entries than most, takes no part and has no row;
    equal and repeated vectors each count; a component without variance (all vectors
    equal in it) has rows with ``whitened`` null and does not count for
    ``identity_error``; ``explained`` is null if no vector differs from another;
    an empty table gives an empty result; other columns are ignored.
    """
    n_dims = dimensions(rows, vector)
    fit_rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")).where(usable(vector, n_dims))
    model = fit(fit_rows, n_dims, components, "vector")
    found = projected(fit_rows, model, "vec_id", "vector")
    error = identity_error(found, int((model.eigenvalues > 0).sum()))
    share = F.array(*[F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.eigenvalues]) if len(model.eigenvalues) else F.array().cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("_at")].alias("explained"), F.lit(error).alias("identity_error"))
