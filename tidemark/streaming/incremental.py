"""Incremental forms of batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import canonicalize_url


def landed(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a landing folder; the checkpoint is the high-water mark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen_urls(stream: DataFrame, url: str, ts: str, late: str = "7 days") -> DataFrame:
    """The first row of each canonical url; state is dropped after ``late``."""
    keyed = stream.withColumn("canonical_url", canonicalize_url(F.col(url)))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["canonical_url"])


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Items of each source and window, late rows included up to ``late``."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("items")).select(F.col("w.start").alias("start"), key, "items")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has landed, then stops."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
