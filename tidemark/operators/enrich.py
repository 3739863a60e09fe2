"""Enrichment in rounds against an index of search results, and tracing of leads to official pages."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.leads import enrichment_queries, quoted
from tidemark.functions.text import normalize_identity

FACTS = ("name", "project_code", "tender_code", "tenderer", "agency")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder of spark.checkpoint.dir; of our own where that is unset on a local master."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def enrichment_rounds(candidates: DataFrame, index: DataFrame, most_rounds: int = 4, most_queries: int = 18) -> tuple[DataFrame, DataFrame]:
    """(candidates, asked): facts filled from results, and every query asked with its round and number of results.

    ``candidates``: candidate_id and the facts ``FACTS``. ``index``: query_text, url and the same facts. Each round asks
    what the known facts newly suggest, in the order of strategies, up to ``most_queries`` for a candidate in all; results
    fill empty facts only, those of the first query first. A candidate that learns nothing asks nothing more.
    """
    spark = candidates.sparkSession
    known = candidates.select("candidate_id", *FACTS)
    asked = spark.createDataFrame([], "candidate_id " + dict(candidates.dtypes)["candidate_id"] + ", query_text string, strategy string, rank int, round int, results long")
    active = known
    found = cut(index.groupBy("query_text").agg(F.count_distinct("url").alias("results"), *[F.min(F.when(F.col(f) != "", F.struct("url", f)))[f].alias(f) for f in FACTS]))
    for step in range(1, most_rounds + 1):
        made = active.select("candidate_id", F.explode(enrichment_queries(*[F.col(f) for f in FACTS])).alias("q")).select("candidate_id", "q.*")
        fresh = made.join(asked, ["candidate_id", "query_text"], "left_anti")
        spent = asked.groupBy("candidate_id").agg(F.count("*").alias("spent"))
        place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("rank", "query_text"))  # at most 18 rows each
        now = fresh.join(spent, "candidate_id", "left").withColumn("place", place).where(F.col("place") + F.coalesce("spent", F.lit(0)) <= most_queries)
        answers = cut(now.join(found, "query_text", "left").select("candidate_id", "query_text", "strategy", "rank", F.coalesce("results", F.lit(0)).alias("results"), *FACTS))
        asked = asked.unionByName(answers.select("candidate_id", "query_text", "strategy", "rank", F.lit(step).alias("round"), "results"))
        learnt = answers.groupBy("candidate_id").agg(*[F.min(F.when(F.col(f).isNotNull(), F.struct("rank", "query_text", f)))[f].alias(f"new_{f}") for f in FACTS])
        empty = lambda f: F.coalesce(F.trim(f), F.lit("")) == ""
        filled = known.join(learnt, "candidate_id", "left").select(
            "candidate_id", *[F.when(empty(f), F.coalesce(f"new_{f}", f)).otherwise(F.col(f)).alias(f) for f in FACTS], reduce(lambda a, b: a | b, [empty(f) & F.col(f"new_{f}").isNotNull() for f in FACTS]).alias("learnt")
        )
        filled = cut(filled)
        known, active = filled.drop("learnt"), filled.where("learnt").drop("learnt")
        if active.isEmpty():
            break
    return known, asked


def identity_agrees(name: Column, codes: Column, text: Column) -> Column:
    """A text names a code or the name, or, of a name of 12 characters or more, its first ten and last six."""
    t, n = normalize_identity(text), normalize_identity(name)
    coded = F.exists(F.coalesce(codes, F.array().cast("array<string>")), lambda c: (normalize_identity(c) != "") & F.contains(t, normalize_identity(c)))
    parts = (F.length(n) >= 12) & F.contains(t, F.substring(n, 1, 10)) & F.contains(t, F.right(n, F.lit(6)))
    return coded | ((n != "") & F.contains(t, n)) | parts


def trace_queries(name: Column, codes: Column, owner: Column) -> Column:
    """At most three queries for a lead's official page: its codes, its name, its name and owner."""
    named = F.length(normalize_identity(name)) >= 4
    by_code = F.transform(F.slice(F.coalesce(codes, F.array().cast("array<string>")), 1, 2), lambda c: F.concat(quoted(c), F.lit(" 招标公告")))
    by_name = F.array(F.when(named, F.concat(quoted(name), F.lit(" 招标公告"))), F.when(named, F.concat(quoted(name), F.lit(" 采购公告"))), F.when(named & (owner != ""), F.concat(quoted(name), F.lit(" "), quoted(owner))))
    return F.slice(F.array_distinct(F.array_compact(F.concat(by_code, by_name))), 1, 3)


def trace_official(leads: DataFrame, index: DataFrame) -> DataFrame:
    """lead_id, status, official_url: the first official result, by query and place, whose text agrees with the lead.

    ``leads``: lead_id, name, codes, owner. ``index``: query_text, place, url, text, is_official, blocked.
    """
    rows = leads.withColumn("queries", trace_queries(F.col("name"), F.col("codes"), F.col("owner")))
    asked = rows.select("lead_id", "name", "codes", F.posexplode("queries").alias("step", "query_text"))
    hits = asked.join(index, "query_text").select("lead_id", "step", "place", "url", F.col("blocked"), (F.col("is_official") & identity_agrees(F.col("name"), F.col("codes"), F.col("text"))).alias("fits"))
    best = hits.groupBy("lead_id").agg(F.min(F.when(F.col("fits") & ~F.col("blocked"), F.struct("step", "place", "url")))["url"].alias("official_url"), F.bool_or("blocked").alias("blocked"))
    status = F.when(F.size("queries") == 0, "NO_IDENTITY").when(F.col("official_url").isNotNull(), "FOUND_OFFICIAL").when(F.coalesce("blocked", F.lit(False)), "BLOCKED").otherwise("NOT_FOUND")
    return rows.join(best, "lead_id", "left").select("lead_id", status.alias("status"), "official_url")
