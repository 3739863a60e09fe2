"""Mixing sources to target weights, in DataFrame functions alone.

Words are summed for each source; targets share the total by weight, and no source may be repeated more than
``most`` times: what a full source can't take is shared again by weight until none is above. The repetition
rate of a source is target over size; each document is emitted floor(rate) times, and once more if a draw,
seeded by a hash of its id, falls below the fraction.

Defined cases. Null text: size 0. Null source: a source of its own, last in order. Null id: drawn as the empty
string. Repeated rows: each counts and is drawn by its id, so alike. A source without words: target and rate 0.
No documents: no rows. Equal draws don't matter, as each is compared with its own fraction. Very long texts are
counted whole, where they are. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_broadcast, n_words, table, written


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, int]:
    """(source, source_size, target, rate) from (source, source_size), and the number of sources; weights repeat over the sources by code point, null last.

    Ranks come from sorted ranges and their counts; each round of sharing is one small aggregation.
    """
    ranges = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for part, n in counts:
        base.append((part, total))
        total += n
    bases = ranges.sparkSession.createDataFrame(base, "part int, base long")
    ranked = ranges.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    cap, level, full = F.col("source_size") * most, 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        r = held.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("full")).first()
        if r["full"] == full or not r["weight"]:
            break
        full, level = r["full"], float(r["all"] - (r["capped"] or 0)) / r["weight"]
    target = F.when(cap < F.col("weight") * F.lit(level), cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return written(held.select("source", "source_size", target.alias("target")).withColumn("rate", rate), "targets"), total


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document as ``row``, with its size, its source's size, target and rate, and the number of copies that the mix takes."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("string").alias("drawn"), F.col(source).alias("of"), n_words(F.col(text)).alias("size"))
    sizes = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets, n = source_targets(sizes, weights, most)
    joined = sized.join(maybe_broadcast(targets, n, 100_000), F.col("of").eqNullSafe(F.col("source")))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("drawn", F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    whole = F.floor("rate")
    copies = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return joined.select("row", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with the columns of ``docs``."""
    copy = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))
    return plan_mix(docs, **options).select("row", copy.alias("copy")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
ordered AS (
  SELECT *, row_number() OVER w AS k,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight::DOUBLE, source)),
level AS (
  SELECT left_size::DOUBLE / left_weight AS level FROM ordered
  WHERE 3 * source_size >= weight * (left_size::DOUBLE / left_weight) ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * (SELECT level FROM level)) AS target FROM weighed),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
