"""Embedding whitening: the leading components of the covariance, and rows projected on them at unit variance.

Components become integers, floor(1024 * c) + 100000, whose sums are exact. Eigenvectors come from a randomised range finder: a basis of a few more columns
than components wanted is multiplied by the covariance, in passes over all centred rows that never hold more than the basis
and its product, and orthogonalised between passes. Rayleigh-Ritz on the basis gives eigenpairs; if their residuals
aren't at rounding after ``PASSES`` passes, the basis is filled up to the full dimension, where one further pass makes them exact.

Defined cases. Vectors that are null, empty, or hold null, non-finite or huge components (2^50 or more) take no part, nor do those of another length
than most. Repeated rows: each counts. Components without variance (rank lower than asked, or one row): ``whitened`` is null, and they aren't in
``identity_error``, which is null if none is left; ``explained`` is null if all variance is zero. Fewer dimensions than components: as many as dimensions. Equal
eigenvalues: any basis of their space. Deviations beyond a long: null. No rows: no rows. Further columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.vectors import as_long, batches_of, fitting, floors

COMPONENTS, OVERSAMPLE, PASSES, SEED = 8, 10, 4, 13
#: Residuals, as a share of the eigenvalue, that count as rounding.
ROUNDING = 1e-12
SHIFT = 100_000


@dataclass
class Components:
    """Number of rows, exact sums of the integers, unit eigenvectors as columns, eigenvalues, the covariance's trace, and passes over the rows."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _summed(partial: DataFrame, column: str, size: int, *key: str) -> list:
    """Arrays of ``size`` summed by position, partly where they are made."""
    return partial.groupBy(*key).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(size)]).alias(column)).collect()


def _exact(length: int, largest: float, n: int) -> bool:
    """Whether int64 holds the sums of all rows, and their squared deviations."""
    m = 2 * (1024 * largest + SHIFT + 1) * max(n, 1)
    return length * m * m < 2**62


def _sums(kept: DataFrame, length: int, exact: bool) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype=object)
        for batch in batches_of(batches):
            total += (floors(batch.column(0), length, exact) + SHIFT).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([[str(x) for x in total]], pa.list_(pa.string()))], ["sums"])

    partial = kept.select("v").mapInArrow(run, "sums array<string>").select(F.col("sums").cast("array<decimal(38,0)>").alias("sums"))
    return [int(x) for x in _summed(partial, "sums", length)[0]["sums"]]


def _times_covariance(kept: DataFrame, length: int, exact: bool, mean: np.ndarray, n: int, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times the basis, from one pass over centred rows, and the covariance's trace."""
    shared, width = kept.sparkSession.sparkContext.broadcast((mean, basis)), basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        product, squares = np.zeros((length, width)), np.zeros(length)
        for batch in batches_of(batches):
            x = (floors(batch.column(0), length, exact) + SHIFT).astype(np.float64) - mean
            product += x.T @ (x @ basis)
            squares += (x * x).sum(axis=0)
        rows = np.concatenate((product, squares[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["at", "row"])

    total = np.empty((length, width + 1))
    for r in _summed(kept.select("v").mapInArrow(run, "at int, row array<double>"), "row", width + 1, "at"):  # a row a dimension
        total[r["at"]] = r["row"]
    return total[:, :width] / n, float(total[:, width].sum() / n)


def leading_components(kept: DataFrame, n: int, length: int, largest: float, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Components:
    """The leading eigenpairs of the covariance of what ``fitting`` returns."""
    exact = _exact(length, largest, n)
    sums = _sums(kept, length, exact)
    mean = np.array([s / n for s in sums])
    k, random = min(components, length), np.random.default_rng([SEED, length])
    basis, _ = np.linalg.qr(random.standard_normal((length, min(length, k + oversample))))
    for done in range(1, passes + 2):
        if done > passes and basis.shape[1] < length:
            # the residuals failed: all dimensions, so the basis spans every eigenvector
            basis, _ = np.linalg.qr(np.concatenate((basis, random.standard_normal((length, length - basis.shape[1]))), axis=1))
        product, trace = _times_covariance(kept, length, exact, mean, n, basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        residuals = np.linalg.norm(product @ turn - vectors * values, axis=0)
        if basis.shape[1] == length or (residuals <= ROUNDING * values).all():
            break
        basis, _ = np.linalg.qr(product)
    return Components(n, sums, vectors / np.linalg.norm(vectors, axis=0), np.maximum(values, 0), trace, done)


def whitened(kept: DataFrame, length: int, largest: float, found: Components) -> DataFrame:
    """``row``, ``deviation`` and ``whitened``, an array with a number for each component (null: without variance)."""
    exact = _exact(length, largest, found.n)
    shared = kept.sparkSession.sparkContext.broadcast((found.n, found.sums, found.mean, found.vectors, found.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, vectors, values = shared.value
        holds = values > max(length, 16) * np.finfo(np.float64).eps * max(values[0], np.finfo(np.float64).tiny)
        scale = np.where(holds, 1 / np.sqrt(np.where(holds, values, 1)), np.nan)
        sums = np.array(sums, dtype=np.int64 if exact else object)
        for batch in batches_of(batches):
            x = floors(batch.column(1), length, exact) + SHIFT
            off = n * x - sums
            w = (x.astype(np.float64) - mean) @ vectors * scale
            flat = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_long((off * off).sum(axis=1)), lists], ["row", "deviation", "whitened"])

    schema = kept.select("row").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return kept.mapInArrow(run, f"{schema}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    mean = _summed(rows, "whitened", k)[0]["whitened"]
    n = rows.count()
    pairs = [(i, j) for i in range(k) for j in range(i, k) if mean[i] is not None and mean[j] is not None]
    if not pairs or not n:
        return None
    centred = [F.col("whitened")[i] - F.lit(mean[i] / n if mean[i] is not None else 0.0) for i in range(k)]
    sums = rows.agg(*[F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> tuple[DataFrame, Components | None]:
    """A written table (``row``, ``deviation``, ``whitened``) of every row that takes part, and the components; without rows, none."""
    kept, n, length, largest = fitting(vectors, embedding)
    if not n:
        return kept.select("row", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    found = leading_components(kept, n, length, largest, components)
    return written(whitened(kept, length, largest, found), "whitened"), found


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = whiten(table(spark, sf_dir, "embeddings"))
    values = found.values if found else np.zeros(0)
    share = F.array(*[F.lit(float(e / found.trace) if found.trace else None).cast("double") for e in values]).cast("array<double>")
    error = identity_error(rows, len(values)) if found else None
    out = rows.select("row.vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
