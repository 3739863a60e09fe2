"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

The first pass scatters records by a seeded hash into as many buckets as make each fit a task's memory; the
second shuffles each bucket (Fisher-Yates, as the built-in array shuffle does it) and writes it. The buckets
one after another are a random order of all records; shards are its equal stretches, so their row counts are
at most one apart (law ``rows``), and a bucket is written to one or two shards.

Rows and bytes are first counted in fine cells of the hash, at most ``CELLS`` of them; all sizes and places follow
from these counts. A bucket is a stretch of cells, and a partition of its own. A cell over the size of a bucket holds
rows of equal id and text, or a very long text: its equal rows are counted before they are moved, and each copy is
scattered over all buckets by its number. A bucket's rows are sorted before they are shuffled, so a task that is run again
shuffles alike.

Defined cases. Null text or id: hashed as such; null text has no bytes. Repeated rows: each gets a slot; rows
equal in all columns may swap theirs. Fewer rows than shards: some shards stay empty. No rows: no shards. A very long
text: no bucket is smaller than its longest row, which a task holds about three times.
Further columns are kept and must be orderable; those named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, table, written

#: Cells of the hash that are counted; their counts go to the driver. There are at most as many buckets.
CELLS = 1 << 18
#: Copies of a row that one task makes.
COPIES = 4096


def plan_buckets(cell: np.ndarray, size: np.ndarray, bucket_bytes: int, least: int) -> tuple[int, np.ndarray]:
    """How many buckets there are, and the cells that are larger than one."""
    total = int(size.sum())
    most = max(bucket_bytes, -(-total // CELLS))
    return max(least, -(-total // most)), cell[size > most]


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_mb: float = 16, least: int = 16, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes all columns of ``docs``, shuffled, with ``slot`` (gapless from 0 in each shard), to ``path``/shard=k.

    There are ``least`` buckets at least, so that small inputs are dealt out too.
    """
    spark, bare = docs.sparkSession, docs.drop("shard", "slot")
    dealt = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    cell = F.shiftrightunsigned(dealt, 64 - (CELLS.bit_length() - 1)).cast("int")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64
    counts = docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"), F.sum(size).alias("size")).toArrow().sort_by("cell")
    held, rows, sizes = (counts[c].to_numpy() for c in ("cell", "rows", "size"))
    buckets, large = plan_buckets(held, sizes, int(bucket_mb * (1 << 20)), least)
    small = ~np.isin(held, large)
    in_bucket = np.bincount(held[small].astype(np.int64) * buckets // CELLS, weights=rows[small], minlength=buckets).astype(np.int64)

    keyed = bare.select(cell.alias("cell"), F.struct(dealt.alias("h"), F.struct(*bare.columns).alias("r")).alias("x"))
    if len(large):
        # a large cell is over a bucket's size, so these are fewer than the buckets
        apart = F.broadcast(spark.createDataFrame([(int(c),) for c in large], "cell int"))
        same = written(keyed.join(apart, "cell").groupBy(F.col("x.r").alias("r")).agg(F.count("*").alias("copies")), "copies")
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
        spread = same.select("*", block.alias("block")).withColumn("deal", F.xxhash64("r", "block")).repartition(F.col("deal"))
        last = F.least(F.col("copies") - 1, F.col("block") * COPIES + (COPIES - 1))
        numbered = spread.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, last)))
        h = F.xxhash64(F.lit(seed), "r", "copy")
        copied = numbered.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.struct(h.alias("h"), "r").alias("x"))
        more = copied.groupBy("bucket").agg(F.count("*").alias("rows")).toArrow()
        np.add.at(in_bucket, more["bucket"].to_numpy(), more["rows"].to_numpy())
        keyed = keyed.join(apart, "cell", "left_anti")
    n = int(in_bucket.sum())
    # a row for each bucket, 12 bytes of it broadcast for its 16 MB of text
    first = spark.createDataFrame([(b, int(x)) for b, x in enumerate(np.cumsum(in_bucket) - in_bucket)], "bucket int, first long")

    scattered = keyed.select(F.expr(f"cast(cell * {buckets}L div {CELLS} as int)").alias("bucket"), "x")
    if len(large):
        scattered = scattered.unionByName(copied)
    scattered = scattered.repartitionById(buckets, F.col("bucket"))
    lists = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list("x")).alias("rows"))
    shuffled = lists.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "x"))
    placed = shuffled.join(F.broadcast(first), "bucket").withColumn("at", F.col("first") + F.col("pos"))
    shard, start = _shard(F.col("at"), n, shards)
    out = placed.withColumn("shard", shard).withColumn("slot", (F.col("at") - start).cast("long")).select("x.r.*", "slot", "shard")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _shard(at: Column, n: int, shards: int) -> tuple[Column, Column]:
    """The shard of a place in the order of all ``n`` records, and the first place of that shard."""
    low, extra = divmod(n, shards)
    edge = extra * (low + 1)
    shard = F.when(at < edge, F.floor(at / (low + 1))).otherwise(extra + F.floor((at - edge) / max(low, 1))).cast("int")
    return shard, F.when(shard < extra, shard * (low + 1)).otherwise(edge + (shard - extra) * low)


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The shards' rows with ``shard`` and ``slot``; ``docs`` gives the schema, as an empty store has no files."""
    schema = docs.drop("shard", "slot").withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    return spark.read.schema(schema).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "shards")
    write_shards(docs, path)
    text = F.coalesce("text", F.lit(""))
    return read_shards(spark, path, docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
