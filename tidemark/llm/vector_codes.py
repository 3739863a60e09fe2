"""Vector code compression: each of four parts of a vector becomes the number of its nearest entry in an integer codebook.

Components become integers, floor(1024 * x), so that every distance, sum and mean is exact and results don't
depend on how rows are dealt. Codebooks begin as the parts of the rows of smallest id and are improved in rounds:
they are broadcast (their size is fixed by parameters), every Arrow batch finds all distances by norm expansion and an int64 matrix product, the first
least one is taken, and what each entry received is summed in the task, then over tasks by a grouped shuffle.

Defined cases. Vectors that are null, empty, or hold null, non-finite or huge components (2^50 or more) take no part, nor do those of
another length than most. A length that the parts don't divide: the first parts are longer by one; parts beyond the length are empty and have code 0.
Equal distances: the lower entry. Fewer rows than entries: as many entries as rows. Repeated rows: each counts. Rows of equal ids
are ordered by their vectors, null ids come last. Entries that receive nothing stay. Errors beyond a long: null. No rows: no rows. Further
columns are kept in ``row``, whatever their names. Vectors of any length are worked on 4096 at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_broadcast, table, written
from tidemark.llm.vectors import as_long, batches_of, fitting, floors

PARTS, ENTRIES, ROUNDS = 4, 256, 4


def _bounds(length: int, parts: int) -> list[tuple[int, int]]:
    sizes = [length // parts + (p < length % parts) for p in range(parts)]
    ends = np.cumsum(sizes)
    return [(int(e - s), int(e)) for s, e in zip(sizes, ends, strict=True)]


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first nearest row of ``book``, and its squared distance: |x|^2 - 2 x.c + |c|^2, in integers."""
    far = (book * book).sum(axis=1) - 2 * (x @ np.ascontiguousarray(book.T))
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code] + (x * x).sum(axis=1)


def _exact(length: int, parts: int, largest: float) -> bool:
    """Whether int64 holds every term of the distances."""
    m = 1024 * largest + 1
    return 4 * length * m * m < 2**62


def trained_codebooks(kept: DataFrame, n: int, length: int, largest: float, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id") -> list[np.ndarray]:
    """Codebooks (entries, part's length), one for each part, from what ``fitting`` returns."""
    bounds, exact = _bounds(length, parts), _exact(length, parts, largest)
    first = kept.select(F.col(f"row.{vec_id}").alias("id"), "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().combine_chunks()
    start = floors(first["v"].combine_chunks(), length, exact)
    books = [start[:, a:b] for a, b in bounds]
    wide = max(b - a for a, b in bounds)
    context = kept.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """For each entry, how many parts it received here and their sums."""
            books = shared.value
            counts = np.zeros((parts, len(books[0])), dtype=np.int64)
            sums = [np.zeros(b.shape, dtype=object) for b in books]
            for batch in batches_of(batches):
                x = floors(batch.column(0), length, exact)
                for p, (a, b) in enumerate(bounds):
                    code, _ = nearest_entries(x[:, a:b], books[p])
                    counts[p] += np.bincount(code, minlength=len(books[p]))
                    order = np.argsort(code, kind="stable")
                    held, firsts = np.unique(code[order], return_index=True)
                    sums[p][held] += np.add.reduceat(x[order, a:b], firsts, axis=0).astype(object)
            part, entry = np.nonzero(counts)
            total = [[str(s) for s in sums[p][e]] for p, e in zip(part, entry, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(total, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

        partial = kept.select("v").mapInArrow(gather, "part int, entry int, n long, sums array<string>").withColumn("sums", F.col("sums").cast("array<decimal(38,0)>"))
        merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(wide)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in merged.collect():  # at most parts x entries rows
            size = books[r["part"]].shape[1]
            books[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"][:size]]
    return books


def coded(kept: DataFrame, length: int, largest: float, books: list[np.ndarray]) -> DataFrame:
    """``row``, ``code`` (two hex digits a part) and ``error`` (the parts' squared distances, summed) for the rows of ``kept``."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    bounds, exact = _bounds(length, len(books)), _exact(length, len(books), largest)
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            x = floors(batch.column(1), length, exact)
            found = [nearest_entries(x[:, a:b], book) for (a, b), book in zip(bounds, shared.value, strict=True)]
            codes = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack([code for code, _ in found], axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes), as_long(sum(far for _, far in found))], ["row", "code", "error"])

    schema = kept.select("row").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return kept.mapInArrow(run, f"{schema}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(``row``, ``code``, ``error``) of every row that takes part, and the codebooks; without rows, no codebooks."""
    kept, n, length, largest = fitting(vectors, embedding)
    if not n:
        return kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    books = trained_codebooks(kept, n, length, largest, parts, entries, rounds, vec_id)
    return coded(kept, length, largest, books), books


def decoded(codes: DataFrame, books: list[np.ndarray], code: str = "code", scale: int = 1024) -> DataFrame:
    """The columns of ``codes`` in ``row``, and ``vector``, the entries that its code names, as doubles."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{len(books[0]) - 1:x}")) if books else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            numbers = [[int(c[i : i + digits], 16) for i in range(0, len(c), digits)] for c in batch.column(1).to_pylist()]
            v = [np.concatenate([book[i] for i, book in zip(row, shared.value, strict=True)]).astype(np.float64) / scale for row in numbers]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in v], pa.list_(pa.float64()))], ["row", "vector"])

    rows = codes.select(F.struct(*codes.columns).alias("row"), F.col(code).alias("code")).where("code is not null")
    schema = rows.select("row").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return rows.mapInArrow(run, f"{schema}, vector array<double>")


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` of ``compress`` with ``label_error``, the errors summed over the rows of an equal label; nulls are one label."""
    rows = written(rows, "codes")
    sums = written(rows.groupBy(F.col(f"row.{label}").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return rows.join(maybe_broadcast(sums, sums.count(), 100_000), F.col(f"row.{label}").eqNullSafe(F.col("of_label"))).drop("of_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(rows).select("row.vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as a chain of tables: entries (part, entry, c), parts (vec_id, label, part, x), and the nearest entry of each."""

    def nearest(k: int) -> str:
        far = "list_dot_product(c, c) - 2 * list_dot_product(x, c) + list_dot_product(x, x)"
        return f"near{k} AS MATERIALIZED (SELECT row_id, part, min((({far})::BIGINT, entry)) AS best FROM parts JOIN book{k} USING (part) GROUP BY row_id, part)"

    steps = []
    for k in range(ROUNDS):
        steps.append(nearest(k))
        steps.append(f"""sums{k} AS (
  SELECT part, best[2] AS entry, i, floor(sum(x[i])::DOUBLE / count(*)) AS c FROM near{k} JOIN parts USING (row_id, part), range(1, 1 + (SELECT max(len(x)) FROM parts)) r(i)
  GROUP BY part, entry, i),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(new.c, old.c) AS c FROM book{k} old LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM sums{k} GROUP BY part, entry) new USING (part, entry))""")
    steps.append(nearest(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row_id, part, list_slice(x, part * len(x) // {PARTS} + 1, (part + 1) * len(x) // {PARTS}) AS x FROM kept, range({PARTS}) r(part)),
book0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, x AS c FROM parts WHERE row_id <= {ENTRIES}),
{(',' + chr(10)).join(steps)},
coded AS (SELECT row_id, string_agg(format('{{:02x}}', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY row_id),
labelled AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN coded USING (row_id) GROUP BY label),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM kept JOIN coded USING (row_id) JOIN labelled ON kept.label IS NOT DISTINCT FROM labelled.label, digest
"""


SQL = _sql()
