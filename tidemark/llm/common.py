"""What the operators share: the shared folder, written tables and batches of whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text; the complement is ASCII white space, as ``bytes.split()`` takes it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset on a local master (tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and lost executors lose nothing of it."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint if the counted ``rows`` are at most ``most``; else the optimizer's shuffled join."""
    return F.broadcast(df) if rows <= most else df


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``most`` bytes of text, or a single row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """``parts`` and their texts as bytes (None: null)."""
    for part in parts(batches, column, most):
        yield part, part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts (binary), and for every word its number among them and its text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    of = split.flatten().dictionary_encode()
    spelled, index = of.dictionary.cast(pa.binary()), of.indices.to_numpy()
    text = np.repeat(np.arange(len(texts), dtype=np.int32), split.value_lengths().to_numpy(zero_copy_only=False))
    # the split leaves empty strings at a text's ends
    empty = pc.index(spelled, pa.scalar(b"", pa.binary())).as_py()
    if empty < 0:
        return spelled, index, text
    real = index != empty
    index, text = index[real], text[real]
    return pa.concat_arrays([spelled.slice(0, empty), spelled.slice(empty + 1)]), index - (index > empty), text
