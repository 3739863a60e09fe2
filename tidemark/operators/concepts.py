"""Queries from concepts, profiles and regions, and what a day's budget allows. Tables of configuration are small; the plans hold for any size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import yes
from tidemark.functions.text import collapse, normalize_identity

#: Terms of a group and relations of it that make queries, and terms of a request without and with depth.
GROUP_TERMS, GROUP_RELATIONS, REQUEST_TERMS, DEEP_TERMS = 6, 2, 12, 20
DEFAULT_RELATION = "parent_project"
DEFAULT_TERMS = ("新能源", "光伏", "储能")
CRAWL_TERMS = 6
ACTIONS = ("招标公告", "采购公告", "询比公告", "资格预审")
OBJECTS = ("EPC", "设备采购", "施工", "监理", "运维")
EXTRAS = (
    ('site:gov.cn "光伏" "招标" filetype:pdf', "official_pdf", 2), ('site:gov.cn "储能系统" "采购公告"', "official_site", 2),
    ('site:mp.weixin.qq.com "新能源" "招标"', "weixin_candidate", 3), ('"新能源" "招标公告" filetype:pdf', "regional_pdf", 3),
)


def expand_concepts(groups: DataFrame, matrix: DataFrame, selected: Sequence[str] = (), relations: Sequence[str] = (), area: str = "", most: int | None = None) -> DataFrame:
    """query_text, group_id, relation, priority, concepts: the rows of a matrix for the selected groups, then each group's first terms by its first relations.

    ``groups``: group_id, priority, terms, relations (arrays). ``matrix``: row, groups, relations, terms, priority. Matrix rows that name groups need one selected;
    without a selection all groups count. Relations are taken in alphabetical order. Of equal texts the matrix, then the better priority stays.
    """
    chosen = groups.where(F.col("group_id").isin(*selected)) if selected else groups
    asked = F.array(*[F.lit(r) for r in relations]) if relations else None
    wanted = lambda c: F.array_intersect(F.array_distinct(c), asked) if asked is not None else F.array_distinct(c)
    said = lambda parts: collapse(F.concat_ws(" ", F.lit(area), parts))
    own = F.array(*[F.lit(g) for g in selected]).cast("array<string>")
    rows = matrix.where((F.size("groups") == 0) | F.arrays_overlap("groups", own)).select("row", "groups", "terms", "priority", F.explode(wanted(F.col("relations"))).alias("relation"))
    by_matrix = rows.select(
        said(F.array_join("terms", " ")).alias("query_text"), F.coalesce(F.get("groups", F.lit(0)), F.lit(selected[0] if selected else "general")).alias("group_id"), "relation", "priority", F.array_distinct("terms").alias("concepts"),
        F.struct(F.lit(0).alias("kind"), F.col("row").cast("string").alias("at")).alias("place"),
    )
    usual = F.sort_array(wanted(F.col("relations")))
    usual = F.slice(F.when(F.size(usual) > 0, usual).otherwise(F.array(F.lit(DEFAULT_RELATION))), 1, GROUP_RELATIONS)
    by_term = chosen.select("group_id", "priority", usual.alias("relations"), F.explode(F.slice("terms", 1, GROUP_TERMS)).alias("term")).select("group_id", "priority", "term", F.explode("relations").alias("relation"))
    by_group = by_term.select(
        said(F.col("term")).alias("query_text"), "group_id", "relation", "priority", F.array("term").alias("concepts"), F.struct(F.lit(1).alias("kind"), F.concat_ws("\x1f", F.lpad(F.col("priority").cast("string"), 3, "0"), "group_id", "relation").alias("at")).alias("place")
    )
    every = by_matrix.unionByName(by_group).where("query_text <> ''")
    first = every.groupBy("query_text").agg(F.min_by(F.struct("group_id", "relation", "priority", "concepts"), "place").alias("x")).select("query_text", "x.*")
    return first if most is None else first.orderBy("priority", "query_text").limit(most)


def search_terms(concept_terms: Column, industry_terms: Column, explicit: Column, profile_terms: Column, excluded: Column, area: Column, deep: Column) -> Column:
    """An ordered array of a request's terms without the excluded ones, each with the area before it, cut to what a request may ask."""
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (concept_terms, industry_terms, explicit, profile_terms)])
    every = F.when(F.size(every) > 0, every).otherwise(F.array(*[F.lit(t) for t in DEFAULT_TERMS]))
    kept = F.array_except(F.filter(every, lambda t: t != ""), F.coalesce(excluded, F.array().cast("array<string>")))
    placed = F.transform(kept, lambda t: F.when((area == "") | F.contains(F.lower(t), F.lower(area)), t).otherwise(F.concat(area, F.lit(" "), t)))
    return F.slice(placed, F.lit(1), F.when(yes(deep), DEEP_TERMS).otherwise(REQUEST_TERMS))


def discovery_queries(regions: DataFrame, terms: Sequence[str], day: int, budget: int, excluded: Sequence[str] = (), wechat: bool = True) -> DataFrame:
    """query_text, category, region, priority, place: regions in their order, rotated by the day, by up to eight terms, an action and an object by place; then fixed extras, for which the budget keeps room.

    ``regions``: region, at (their order). The product of regions and terms is cut at the budget before anything is read.
    """
    terms = [t for t in dict.fromkeys(terms) if t and t not in excluded][:8] or ["新能源"]
    extras = [x for x in EXTRAS if wechat or x[1] != "weixin_candidate"]
    base = max(0, budget - len(extras))
    spark = regions.sparkSession
    ordered = regions.groupBy("region").agg(F.min("at").alias("at"))
    n = ordered.count()
    first = day % max(1, n)
    # of any number of regions the budget's, from the day's place on and then from the beginning: each asks at least once
    turned = ordered.orderBy("at").offset(first).limit(min(base, n - first)).withColumn("again", F.lit(0))
    if base > n - first:
        turned = turned.unionByName(ordered.orderBy("at").limit(min(base - (n - first), first)).withColumn("again", F.lit(1)))
    turned = turned.withColumn("index", F.row_number().over(Window.orderBy("again", "at")) - 1)
    word = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))
    asked = turned.select("region", "index", F.posexplode(F.array(*[F.lit(t) for t in terms])).alias("t", "term"))
    text = F.concat_ws(" ", *[F.concat(F.lit('"'), c, F.lit('"')) for c in (F.col("region"), F.col("term"), word(ACTIONS, F.col("index") + day), word(OBJECTS, F.col("index") + F.length("term")))])
    made = asked.select(text.alias("query_text"), F.lit("region_industry_action_object").alias("category"), "region", (F.col("index") / 5).cast("int").alias("fifth"), (F.col("index") * 8 + F.col("t")).alias("place"))
    for word_ in excluded:
        made = made.where(~F.contains(F.lower("query_text"), F.lit(word_.lower())))
    made = made.orderBy("place").limit(base).select("query_text", "category", "region", (F.col("fifth") + 1).alias("priority"), F.col("place").cast("long").alias("place"))
    fixed = spark.createDataFrame([(q, c, None, p, 10**12 + i) for i, (q, c, p) in enumerate(extras)], "query_text string, category string, region string, priority int, place long")
    return made.unionByName(fixed).orderBy("place").limit(budget)


@dataclass(frozen=True)
class Budget:
    """A profile's limits of queries."""

    per_day: int = 200
    coverage: int = 48
    discovery: int = 12
    enrichment: int = 24
    verification: int = 12


def daily_plan(sessions: DataFrame, profile_id: str, day_start: Column, limits: Budget, n_terms: int, n_sources: int, discovery: bool = False, deep: bool = False) -> DataFrame:
    """One row of what a profile may still ask today: each budget after those before it, and terms for each source. ``sessions``: profile_id, started_at, query_count."""
    used = sessions.where((F.col("profile_id") == profile_id) & (F.col("started_at") >= day_start)).agg(F.coalesce(F.sum("query_count"), F.lit(0)).cast("long").alias("used"))
    left = F.greatest(F.lit(0), F.lit(limits.per_day) - F.col("used"))
    cover = F.least(F.lit(limits.coverage), F.col("left"))
    each = F.when((F.col("coverage") > 0) & F.lit(n_sources > 0), F.greatest(F.lit(1), F.expr(f"coverage div {max(1, n_sources)}"))).otherwise(0)
    cap = F.least(F.lit(min(limits.discovery, 12 if deep else 6)), F.greatest(F.lit(0), F.col("left") - F.col("coverage"))) if discovery or deep else F.lit(0)
    rest = lambda most: F.least(F.lit(most), F.greatest(F.lit(0), F.col("left") - F.col("crawl") - F.col("discovery")))
    out = used.withColumn("left", left).withColumn("coverage", cover).withColumn("terms_per_source", F.least(F.lit(n_terms), each))
    out = out.withColumn("crawl", F.col("terms_per_source") * n_sources).withColumn("discovery", F.least(cap, F.greatest(F.lit(0), F.col("left") - F.col("crawl"))))
    return out.withColumns({"enrichment": rest(limits.enrichment), "verification": rest(limits.verification)})


def crawl_terms(keywords: Column, industry_terms: Column, excluded: Column) -> Column:
    """The first of a profile's keywords and industry terms without the excluded ones; defaults if none is left."""
    kept = F.array_except(F.concat(keywords, industry_terms), excluded)
    return F.when(F.size(kept) > 0, F.slice(kept, 1, CRAWL_TERMS)).otherwise(F.array(*[F.lit(t) for t in DEFAULT_TERMS]))


def source_in_region(region: Column, requested: str, path: Sequence[str] = (), labels: Sequence[str] = ()) -> Column:
    """A source concerns a request: it, or the request, is nationwide; the request names its region, or lies below it (``path``); or its region is one of the labels of the places selected by code."""
    own, whole = normalize_identity(F.coalesce(F.nullif(F.trim(region), F.lit("")), F.lit("全国"))), ("全国", "全国性", "全网")
    if requested in whole:
        return F.lit(True)
    fits = own.isin(*whole[:2])
    for text in (requested, *path) if requested else labels:
        fits = fits | F.contains(normalize_identity(F.lit(text)), own)
    return fits
