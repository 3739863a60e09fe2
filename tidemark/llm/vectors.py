"""Vectors that can be counted with: what the operators on integer vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Components of this size or more take no part: their integers and the sums of those leave what the engine's decimals hold.
LARGEST = float(1 << 50)
#: Vectors that a task works on at once.
BATCH = 4096


def usable(v: Column) -> Column:
    """Neither null nor empty, and all components finite numbers below ``LARGEST``."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))


def fitting(vectors: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, int, int, float]:
    """A table (``row``: the columns of ``vectors``; ``v``: the vector) of the usable rows, their number, length and largest component.

    Rows whose vector has another length than most (of two equally frequent lengths, the smaller counts) aren't in it.
    """
    kind = "float" if dict(vectors.dtypes)[embedding] == "array<float>" else "double"
    rows = vectors.select(F.struct(*vectors.columns).alias("row"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    kept = written(rows.where(usable(F.col("v"))), "vectors")
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    lengths = kept.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), largest.cast("double").alias("largest"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    if most is None:
        return kept, 0, 0, 0.0
    return kept.where(F.size("v") == most["length"]), most["n"], most["length"], most["largest"]


def floors(column: pa.Array, length: int, exact: bool, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) of vectors of equal length: int64, or Python's integers where int64 isn't ``exact``."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, length)
    return x.astype(np.int64) if exact else np.frompyfunc(int, 1, 1)(x)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            yield whole.slice(at, BATCH)


def as_long(values: np.ndarray) -> pa.Array:
    """Integers as longs; null for those that a long can't hold."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if -(1 << 63) <= x < 1 << 63 else None for x in values], pa.int64())
