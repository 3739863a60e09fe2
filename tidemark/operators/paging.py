"""Pages of ordered rows with their total, and documents of ordered rows written together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """The rows of a page in order, the number of all rows, and the key behind which the next page begins (None: this one is the last)."""

    rows: DataFrame
    total: int
    after: tuple | None


def _ordered(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def _behind(order: Sequence[tuple[str, bool]], after: Sequence[object], kinds: Mapping[str, str]) -> Column:
    """Whether a row comes after a key: equal in the first columns and later in the next; nulls are last."""
    cases = []
    for i, (c, down) in enumerate(order):
        if after[i] is None:
            continue  # nothing is later than null
        value = F.lit(after[i]).cast(kinds[c])
        later = (F.col(c) < value if down else F.col(c) > value) | F.col(c).isNull()
        cases.append(reduce(and_, [F.col(b).eqNullSafe(F.lit(after[j]).cast(kinds[b])) for j, (b, _) in enumerate(order[:i])], later))
    return F.coalesce(reduce(or_, cases, F.lit(False)), F.lit(False))


def page_of(rows: DataFrame, order: Sequence[tuple[str, bool]], size: int, after: Sequence[object] | None = None) -> Page:
    """The next ``size`` rows behind a key, in ``order`` of (column, descending), whose last column tells rows apart; and the number of all rows from the same pass.

    No rows are sorted or skipped that the page hasn't: each task keeps the first of its rows behind the key. Only the page reaches the driver.
    """
    counted = Observation()
    seen = rows.observe(counted, F.count(F.lit(1)).alias("n"))
    found = (seen.where(_behind(order, after, dict(rows.dtypes))) if after is not None else seen).orderBy(*_ordered(order)).limit(size + 1).collect()
    page = found[:size]
    last = tuple(page[-1][c] for c, _ in order) if len(found) > size else None
    return Page(rows.sparkSession.createDataFrame(page, rows.schema), counted.get["n"], last)


#: The documents of a session, in order.
DOCUMENTS = ("results", "candidate_pool", "open_projects", "unknown_projects", "layers", "valuable_leads", "errors", "sources")


def write_documents(rows: DataFrame, path: str, member: Mapping[str, Column], order: Sequence[Column]) -> None:
    """The documents of a session as folders of JSON lines, each in order, from one pass over the rows: ``member`` says which rows a document has.

    Rows are dealt to ranges of document and order, so a document is as many files as its size asks for, whose names follow its order. A document without rows is no folder.
    """
    unknown = set(member) - set(DOCUMENTS)
    if unknown:
        raise ValueError(f"no documents of a session: {', '.join(sorted(unknown))}")
    of = F.array_compact(F.array(*[F.when(F.coalesce(member[d], F.lit(False)), F.lit(d)) for d in DOCUMENTS if d in member]))
    dealt = rows.select(F.explode(of).alias("_document"), *rows.columns)
    placed = dealt.repartitionByRange("_document", *order).sortWithinPartitions("_document", *order)
    placed.select(F.col("_document").alias("document"), F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def read_document(spark: SparkSession, path: str, document: str) -> DataFrame:
    """(place, value) of a document's lines: the place is the file's, then the line's, so it sorts as the document does."""
    lines = spark.read.text(f"{path.rstrip('/')}/document={document}")
    return lines.select(F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line")).alias("place"), "value")
