"""Views of the driver's tables as projects, evidence and announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import NONE, STRONG, TIME_FIELDS, WEAK

NOW = "1998-08-01 12:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores, for work that costs far more than moving them; a table of many files is dealt so already."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as projects whose dates follow from the key."""
    day = lambda n, when: f"CASE WHEN {when} THEN o_orderdate + make_dt_interval({n}) END"
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS project_id", "o_custkey", "o_orderdate AS publish_time", "o_totalprice", "o_orderpriority", "o_orderstatus",
        f"{day('50', 'o_orderkey % 13 = 0')} AS qualification_start",
        f"{day('CASE WHEN o_orderkey % 13 = 0 THEN 10 ELSE 45 END', 'o_orderkey % 13 IN (0, 1)')} AS qualification_deadline",
        f"{day('0', 'o_orderkey % 5 <> 0')} AS registration_start", f"{day('CAST(o_orderkey % 40 AS INT)', 'o_orderkey % 5 <> 0')} AS registration_deadline",
        f"{day('0', 'o_orderkey % 7 <> 0')} AS document_start", f"{day('CAST(o_orderkey % 60 AS INT)', 'o_orderkey % 7 <> 0')} AS document_deadline",
        f"{day('CAST(30 + o_orderkey % 90 AS INT)', 'o_orderkey % 11 <> 0')} AS bid_deadline", f"{day('CAST(20 + o_orderkey % 90 AS INT)', 'o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0')} AS open_time",
        "o_orderpriority LIKE '1-%' AS has_marker",
    )


def evidence(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A row for each project, time field and the participation text, with its strength and, if named, columns of the project's order."""
    k = F.col("o_orderkey")
    strength = lambda i: F.when((k + i) % 61 == 0, WEAK).when((k + i) % 67 == 0, NONE).otherwise(STRONG)
    rows = [F.struct(F.lit(f).alias("field_name"), strength(i).alias("strength")) for i, f in enumerate(TIME_FIELDS)]
    rows.append(F.struct(F.lit("participation").alias("field_name"), F.lit(STRONG).alias("strength")))
    return load(spark, sf_dir, "orders").select(k.alias("project_id"), *columns, F.explode(F.array(*rows)).alias("e")).select("project_id", *columns, "e.*")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS project_id", "l_linenumber AS id", "l_shipdate AS published_at", "l_returnflag AS kind", "l_quantity")


#: The same views in SQL.
PROJECTS = """
projects AS (
  SELECT o_orderkey AS project_id, o_orderdate AS publish_time, o_orderpriority, o_orderstatus, o_custkey, o_totalprice,
    CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate + INTERVAL 50 DAY END AS qs,
    CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate + INTERVAL 10 DAY WHEN o_orderkey % 13 = 1 THEN o_orderdate + INTERVAL 45 DAY END AS qd,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS rs,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days((o_orderkey % 40)::INT) END AS rd,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS ds,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days((o_orderkey % 60)::INT) END AS dd,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_days((30 + o_orderkey % 90)::INT) END AS bid,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 THEN o_orderdate + to_days((20 + o_orderkey % 90)::INT) END AS opened,
    o_orderpriority LIKE '1-%' AS marker
  FROM orders),
gated AS (
  SELECT *, list_filter([""" + ", ".join(f"CASE WHEN {c} IS NOT NULL AND (project_id + {i}) % 61 <> 0 AND (project_id + {i}) % 67 = 0 THEN '{f}' END" for i, (c, f) in enumerate(zip(("qs", "qd", "rs", "rd", "ds", "dd", "bid", "opened"), TIME_FIELDS, strict=True))) + """], lambda x: x IS NOT NULL) AS missing,
    list_filter([""" + ", ".join(f"CASE WHEN {c} IS NOT NULL AND (project_id + {i}) % 61 = 0 THEN '{f}' END" for i, (c, f) in enumerate(zip(("qs", "qd", "rs", "rd", "ds", "dd", "bid", "opened"), TIME_FIELDS, strict=True))) + """], lambda x: x IS NOT NULL) AS weak
  FROM projects),
reasons AS (
  SELECT *, CASE
    WHEN qs > qd OR rs > rd OR ds > dd THEN 'UNKNOWN_CONFLICTING_DATES'
    WHEN len(missing) > 0 OR len(weak) > 0 THEN 'UNKNOWN_NEEDS_CODEX_REVIEW'
    WHEN qd <= now THEN 'CLOSED_QUALIFICATION_EXPIRED' WHEN rd <= now THEN 'CLOSED_REGISTRATION_EXPIRED'
    WHEN dd <= now THEN 'CLOSED_DOCUMENT_DEADLINE_EXPIRED' WHEN bid <= now THEN 'CLOSED_BID_DEADLINE_EXPIRED' WHEN opened <= now THEN 'CLOSED_OPENED'
    WHEN bid > now AND (opened IS NULL OR opened > now) AND rd > now AND (rs IS NULL OR rs <= now) THEN 'OPEN_REGISTRATION_ACTIVE'
    WHEN bid > now AND (opened IS NULL OR opened > now) AND dd > now AND (ds IS NULL OR ds <= now) THEN 'OPEN_DOCUMENT_DOWNLOAD_ACTIVE'
    WHEN bid > now AND (opened IS NULL OR opened > now) AND marker THEN 'OPEN_PARTICIPATION_ACTIVE'
    WHEN coalesce(bid <= now, true) AND (qd IS NOT NULL OR rd IS NOT NULL OR dd IS NOT NULL) THEN 'UNKNOWN_NO_BID_DEADLINE'
    WHEN bid > now AND qd IS NULL AND rd IS NULL AND dd IS NULL AND NOT marker THEN 'UNKNOWN_NO_PARTICIPATION_DEADLINE'
    WHEN coalesce(qd, rd, dd, bid, opened) IS NOT NULL THEN 'UNKNOWN_SOURCE_INCOMPLETE'
    ELSE 'UNKNOWN_NO_PARTICIPATION_DEADLINE' END AS reason_code
  FROM gated, (SELECT TIMESTAMP '1998-08-01 12:00:00' AS now))
"""
