"""Queries of extraction, review, discovery and configuration steps, bound to the driver's tables by formulas that SQL states too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import leads as L
from tidemark.operators import concepts, findings, runs
from tidemark.plans.bindings import NOW, PROJECTS, load, projects, spread
from tidemark.plans.catalog import now, query
from tidemark.sources import html as H


@query("""WITH g AS (SELECT p_brand AS g, min(p_size) % 3 AS pr, list_sort(list(DISTINCT p_name))[:6] AS terms FROM part GROUP BY 1),
  rows AS (SELECT 'X ' || r_name || ' EPC' AS q, 'general' AS g, 'parent_project' AS rel, r_regionkey::INT AS pr, 0 AS kind, r_regionkey::VARCHAR AS ord FROM region
    UNION ALL SELECT 'X ' || term, g, rel, pr, 1, lpad(pr::VARCHAR, 3, '0') || chr(31) || g || chr(31) || rel FROM (SELECT g, pr, unnest(terms) AS term FROM g), (SELECT unnest(['a_rel', 'b_rel']) AS rel))
  SELECT q AS query_text, g AS group_id, rel AS relation, pr::INT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY kind, ord) AS k FROM rows) WHERE k = 1""")
def concept_expand(spark: SparkSession, sf: str) -> DataFrame:
    part, region = load(spark, sf, "part"), load(spark, sf, "region")
    groups = part.groupBy(F.col("p_brand").alias("group_id")).agg(F.expr("cast(min(p_size) % 3 as int)").alias("priority"), F.array_sort(F.collect_set("p_name")).alias("terms")).withColumn("relations", F.array(*[F.lit(r) for r in ("c_rel", "b_rel", "a_rel")]))
    matrix = region.selectExpr("cast(r_regionkey as int) AS row", "cast(array() as array<string>) AS groups", "array(r_name, 'EPC') AS terms", "array('parent_project') AS relations", "cast(r_regionkey as int) AS priority")
    return concepts.expand_concepts(groups, matrix, area="X").select("query_text", "group_id", "relation", "priority")


@query("""WITH c AS (SELECT c_custkey, list_filter(list_distinct_ordered, lambda t: t <> 'drop') AS kept, c_custkey % 3 = 0 AS deep, CASE WHEN c_custkey % 2 = 0 THEN '甘肃' ELSE '' END AS area FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [c_mktsegment, 'drop', '甘肃光伏', c_name] WHEN 1 THEN [c_name, c_mktsegment] WHEN 2 THEN ['新能源', '光伏', '储能'] ELSE [c_mktsegment] END AS list_distinct_ordered FROM customer))
  SELECT c_custkey, array_to_string(list_transform(kept, lambda t: CASE WHEN area = '' OR contains(t, area) THEN t ELSE area || ' ' || t END), '|') AS terms FROM c""")
def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    none, k = F.array().cast("array<string>"), F.col("c_custkey") % 4
    concept = F.when(k == 0, F.array("c_mktsegment", F.lit("drop"))).when(k == 1, F.array("c_name")).when(k == 3, F.array("c_mktsegment", F.lit(""))).otherwise(none)
    industry = F.when(k == 0, F.array(F.lit("甘肃光伏"), F.col("c_mktsegment"))).otherwise(none)
    explicit, profile = F.when(k == 0, F.array("c_name")).otherwise(none), F.when(k == 1, F.array("c_name", "c_mktsegment")).otherwise(none)
    area = F.when(F.col("c_custkey") % 2 == 0, "甘肃").otherwise("")
    made = concepts.search_terms(concept, industry, explicit, profile, F.array(F.lit("drop")), area, F.col("c_custkey") % 3 == 0)
    return load(spark, sf, "customer").select("c_custkey", F.array_join(made, "|").alias("terms"))


@query("""WITH n AS (SELECT n_name AS r, (row_number() OVER (ORDER BY n_nationkey) - 1 - 7 % 25 + 25) % 25 AS i FROM nation),
  q AS (SELECT i * 8 + t AS place, '"' || r || '" "' || w || '" "' || (['招标公告', '采购公告', '询比公告', '资格预审'])[(i + 7) % 4 + 1] || '" "' || (['EPC', '设备采购', '施工', '监理', '运维'])[(i + length(w)) % 5 + 1] || '"' AS query_text, r AS region, 1 + i // 5 AS priority
    FROM n, (SELECT unnest([0, 1, 2]) AS t, unnest(['光伏', '储能系统', '风电']) AS w) WHERE i < 44)
  SELECT query_text, 'region_industry_action_object' AS category, region, priority::INT AS priority FROM (SELECT * FROM q ORDER BY place LIMIT 44)
  UNION ALL SELECT unnest(['site:gov.cn "光伏" "招标" filetype:pdf', 'site:gov.cn "储能系统" "采购公告"', 'site:mp.weixin.qq.com "新能源" "招标"', '"新能源" "招标公告" filetype:pdf']), unnest(['official_pdf', 'official_site', 'weixin_candidate', 'regional_pdf']), NULL, unnest([2, 2, 3, 3])""")
def discovery_queries(spark: SparkSession, sf: str) -> DataFrame:
    regions = load(spark, sf, "nation").selectExpr("n_name AS region", "n_nationkey AS at")
    return concepts.discovery_queries(regions, ["光伏", "储能系统", "光伏", "风电", "不要"], 7, 48, ["不要"]).select("query_text", "category", "region", "priority")


@query("WITH u AS (SELECT coalesce(sum(o_orderkey % 3), 0)::BIGINT AS used FROM orders WHERE o_custkey % 50 = 7 AND o_orderdate >= TIMESTAMP '1998-01-01'), l AS (SELECT used, greatest(0, 200 - used) AS l FROM u), c AS (SELECT *, least(48, l) AS cov FROM l), t AS (SELECT *, least(9, CASE WHEN cov > 0 THEN greatest(1, cov // 10) ELSE 0 END) AS tps FROM c), d AS (SELECT *, tps * 10 AS crawl, least(least(12, greatest(0, l - cov)), greatest(0, l - tps * 10)) AS disc FROM t) SELECT used, l::BIGINT AS remaining, cov::BIGINT AS coverage, tps::BIGINT AS terms_per_source, crawl::BIGINT AS crawl, disc::BIGINT AS discovery, least(24, greatest(0, l - crawl - disc))::BIGINT AS enrichment, least(12, greatest(0, l - crawl - disc))::BIGINT AS verification FROM d")
def daily_plan(spark: SparkSession, sf: str) -> DataFrame:
    sessions = load(spark, sf, "orders").selectExpr("concat('p', o_custkey % 50) AS profile_id", "o_orderdate AS started_at", "o_orderkey % 3 AS query_count")
    plan = concepts.daily_plan(sessions, "p7", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), concepts.Budget(), 9, 10, discovery=True, deep=True)
    return plan.withColumnRenamed("left", "remaining").select("used", *[F.col(c).cast("long").alias(c) for c in ("remaining", "coverage", "terms_per_source", "crawl", "discovery", "enrichment", "verification")])


@query("SELECT s_suppkey AS source_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 5 = 0 OR n_name IN ('NATION_2', 'NATION_1') AND s_suppkey % 5 <> 0 OR r_name = 'ASIA' AND s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0")
def sources_in_region(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = load(spark, sf, "supplier"), load(spark, sf, "nation"), load(spark, sf, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    region = F.when(F.col("s_suppkey") % 5 == 0, "全国").when(F.col("n_name").isin("NATION_2", "NATION_1"), F.col("n_name")).when(F.col("s_suppkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name"))
    return j.where(concepts.source_in_region(region, "NATION_2", path=("ASIA", "NATION_1"))).select(F.col("s_suppkey").alias("source_id"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'CAPTCHA' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'RATE_LIMITED' ELSE 'HTTP_ERROR' END WHEN 'error' THEN 'PARSER_ERROR' WHEN 'signup' THEN 'LOGIN_REQUIRED' ELSE 'HTTP_ERROR' END AS reason,
  CASE event_type WHEN 'click' THEN 'PENDING_USER' WHEN 'signup' THEN 'PENDING_USER' END AS state, CASE event_type WHEN 'click' THEN 'CAPTCHA' WHEN 'signup' THEN 'LOGIN_REQUIRED' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'VERIFICATION_REQUIRED' END END AS provider,
  CASE WHEN event_id % 5 = 0 THEN 'LOGIN_REQUIRED' WHEN event_id % 2 = 0 THEN NULL WHEN event_type = 'click' THEN 'CAPTCHA' WHEN event_type = 'signup' THEN 'LOGIN_REQUIRED' ELSE 'VERIFICATION_REQUIRED' END AS configured FROM events""")
def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").selectExpr("event_id", "CASE event_type WHEN 'click' THEN 'page shows 验证码' WHEN 'view' THEN 'status' WHEN 'error' THEN 'no selector' WHEN 'signup' THEN '请登录 login' ELSE 'timeout' END AS message", "event_type", "IF(event_type = 'view', IF(event_id % 2 = 0, 429, 500), NULL) AS status")
    reason = runs.health_reason(F.col("message"), F.col("status"), manual=F.when(F.col("event_type") == "signup", "LOGIN_REQUIRED"))
    rows = e.withColumn("reason", reason)
    return rows.select(
        "event_id", "reason", runs.manual_action(F.col("reason"), F.lit(None).cast("string"))["state"].alias("state"), runs.provider_action(F.col("message"), F.when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), 412)).alias("provider"),
        runs.configured_action(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 1, "NEEDS_ATTENTION").otherwise("ACTIVE"), F.col("message")).alias("configured"),
    )


_N = "(SELECT l_orderkey AS p, l_linenumber AS a, max(l_returnflag) AS h, max(l_suppkey) AS s FROM lineitem WHERE {} GROUP BY 1, 2)"


@query(f"""WITH o AS {_N.format('l_linenumber <= 2')}, n AS {_N.format('l_linenumber >= 2 AND l_suppkey % 3 <> 0')}
  SELECT coalesce(o.p, n.p) AS project_id, coalesce(o.a, n.a) AS announcement_id, CASE WHEN n.p IS NOT NULL THEN 'NEW' ELSE 'OLD' END AS reason, CASE WHEN n.p IS NOT NULL THEN n.s % 5 ELSE 5 END::INT AS priority,
    CASE WHEN o.p IS NULL OR (n.p IS NOT NULL AND o.h <> n.h || '1') THEN 'PENDING' ELSE 'RESOLVED' END AS status, CASE WHEN o.p IS NOT NULL AND n.p IS NOT NULL AND o.h <> n.h || '1' THEN 'CONTENT_CHANGED_REQUIRES_REVIEW' WHEN o.p IS NOT NULL THEN 'done' END AS resolution FROM o FULL JOIN n ON o.p = n.p AND o.a = n.a""")
def review_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda when: load(spark, sf, "lineitem").where(when).groupBy(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("announcement_id")).agg(F.max("l_returnflag").alias("content_hash"), F.max("l_suppkey").alias("s"))
    old = rows("l_linenumber <= 2").select(F.concat_ws("-", "project_id", "announcement_id").alias("review_id"), "project_id", "announcement_id", F.lit("OLD").alias("reason"), F.lit(5).alias("priority"), "content_hash", F.lit("RESOLVED").alias("status"), F.lit("done").alias("resolution"), now().alias("resolved_at"), now().alias("created_at"))
    new = rows("l_linenumber >= 2 AND l_suppkey % 3 <> 0").select("project_id", "announcement_id", F.array(F.lit("NEW")).alias("reasons"), (F.col("s") % 5).cast("int").alias("priority"), F.concat("content_hash", F.lit("1")).alias("content_hash"))
    return runs.review_items(old, new, now()).select("project_id", "announcement_id", "reason", "priority", "status", "resolution")


@query("SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'RESOLVED' ELSE 'SKIPPED' END ELSE 'PENDING' END AS status, o_orderkey % 2 = 0 AS ended FROM orders")
def review_resolution(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    items = o.select(F.col("o_orderkey").alias("review_id"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    decided = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 3 == 0, "RESOLVED").otherwise("SKIPPED").alias("decision"), F.lit("n").alias("note"))
    return runs.resolve_reviews(items, decided, now()).select("review_id", "status", F.col("resolved_at").isNotNull().alias("ended"))


@query("SELECT l_orderkey AS project_id, l_returnflag AS announcement_id, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS review_id FROM lineitem GROUP BY 1, 2")
def latest_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS project_id", "l_returnflag AS announcement_id", "l_shipdate AS created_at", "l_linenumber AS review_id")
    return runs.latest_review(rows).select("project_id", "announcement_id", "review_id")


@query(f"""WITH {PROJECTS}, e AS (SELECT l_orderkey AS o, l_linenumber AS a, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS ids FROM lineitem WHERE l_quantity < 20 GROUP BY 1, 2),
  n AS (SELECT l_orderkey AS project_id, l_linenumber AS a, max(l_shipdate) AS seen, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
  SELECT project_id * 10 + n.a AS announcement_id, project_id, CASE f WHEN 'R' THEN 'DEADLINE_CHANGED' WHEN 'A' THEN 'CLARIFICATION_PUBLISHED' ELSE 'ANNOUNCEMENT_PUBLISHED' END AS event_type, seen AS event_at, coalesce(ids, '') AS evidence_ids,
    bid IS NOT NULL AS has_bid FROM n JOIN projects USING (project_id) LEFT JOIN e ON e.o = project_id AND e.a = n.a""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    notes = li.groupBy(F.col("l_orderkey").alias("project_id"), key.alias("id")).agg(F.max("l_shipdate").alias("published_at"), F.max("l_returnflag").alias("f")).select("id", "project_id", "published_at", F.when(F.col("f") == "R", "extension").when(F.col("f") == "A", "clarification").otherwise("original").alias("kind"), F.lit("t").alias("title"))
    proof = li.where("l_quantity < 20").select(F.col("l_partkey").alias("id"), key.alias("announcement_id"))
    schema = "announcement_id long, project_id long, event_type string, event_at timestamp_ntz, title string, deadlines string, evidence_ids array<bigint>"
    events = runs.timeline_events(spark.createDataFrame([], schema), notes, projects(spark, sf), proof)
    return events.select("announcement_id", "project_id", "event_type", "event_at", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("evidence_ids"), F.get_json_object("deadlines", "$.bid_deadline").isNotNull().alias("has_bid"))


@query("""SELECT o_orderkey AS project_id, 'capacity_mw' AS field_name, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100)::DOUBLE::VARCHAR ELSE 'old' END AS manual_value, true AS active, 'auto' AS automatic_value FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'capacity_mw', 'old', false, 'auto' FROM orders WHERE o_orderkey % 6 = 0""")
def correction_overrides(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey").alias("project_id")
    field = F.lit("capacity_mw").alias("field_name")
    old = o.where("o_orderkey % 2 = 0").select(k, field, F.lit("auto").alias("automatic_value"), F.lit("old").alias("manual_value"), now().alias("changed_at"), F.lit(True).alias("active"))
    asked = o.where("o_orderkey % 3 = 0").select(k, field, F.concat(F.lit(" "), (F.col("o_orderkey") % 100).cast("string")).alias("value"), F.lit("seen").alias("evidence_text"), F.lit("http://x").alias("source_url"))
    none = spark.createDataFrame([], "project_id long, field_name string, resolution_status string")
    made, _, _ = runs.corrections(old, asked, none, 1998, now())
    return made.select("project_id", "field_name", "manual_value", "active", F.coalesce("automatic_value", F.lit("auto")).alias("automatic_value"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"seen\":\"y\"}' WHEN event_id % 3 = 1 THEN '{\"snippet\":\"note\",\"seen\":\"y\"}' ELSE '{\"k\":\"new\",\"seen\":\"y\"}' END AS notes FROM events")
def merged_notes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    old = F.when(k == 0, F.col("props")).when(k == 1, "note").otherwise(F.col("props"))
    new = F.when(k == 2, '{"k": "new", "seen": "y"}').otherwise('{"seen": "y"}')
    return load(spark, sf, "events").select("event_id", runs.merged_notes(old, new).alias("notes"))


@query(f"""WITH s AS (SELECT url AS source_url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS domain, max(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END) AS found, max(page_id % 3 <> 0) AS fresh, bool_or(page_id % 3 = 0) AS old FROM pages GROUP BY 1, 2),
  t AS (SELECT domain FROM s GROUP BY 1 HAVING sum(found) >= 3)
  SELECT source_url, domain, found::INT AS projects_found, CASE WHEN fresh THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '1998-01-01' END AS last_seen_at, CASE WHEN domain IN (SELECT domain FROM t) AND NOT contains(domain, 'a') THEN 'RECOMMENDED_NEW_SOURCE' ELSE 'DISCOVERED' END AS status FROM s""")
def discovered_sources(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", F.col("url").alias("source_url"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)).alias("domain"))
    first = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    old = pages.where("page_id % 3 = 0").groupBy("source_url", "domain").agg(F.max(F.when(F.col("page_id") % 2 == 0, 1).otherwise(0)).alias("projects_found")).withColumns({"first_seen_at": first, "last_seen_at": first})
    new = pages.where("page_id % 3 <> 0").select("source_url", "domain", (F.col("page_id") % 2 == 0).alias("is_candidate"))
    known = pages.where("domain like '%a%'").select("domain").distinct()
    return runs.discovered(old, new, known, now()).select("source_url", "domain", "projects_found", "last_seen_at", "status")


@query("SELECT l_orderkey AS announcement_id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS attachment_id, max(CASE WHEN l_linenumber > 3 THEN 1000 ELSE 0 END + l_linenumber) AS document_id, CASE WHEN max(l_linenumber) > 3 AND max(l_linenumber) % 2 = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS parse_status FROM lineitem GROUP BY 1, 2")
def parse_upsert(spark: SparkSession, sf: str) -> DataFrame:
    def parses(when: str, base: int) -> DataFrame:
        rows = load(spark, sf, "lineitem").where(when).groupBy(F.col("l_orderkey").alias("announcement_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("attachment_id")).agg(F.max("l_linenumber").alias("n"))
        return rows.select("announcement_id", "attachment_id", F.lit(None).cast("string").alias("candidate_id"), F.lit("h").alias("content_hash"), (F.col("n") + base).alias("document_id"), F.when(F.col("n") % 2 == 0, "text").alias("text"), F.when(F.col("n") % 2 == 1, "broken").alias("error"), F.lit("SUCCESS").alias("parse_status"))

    return runs.document_parses(parses("l_linenumber <= 3", 0), parses("l_linenumber > 3", 1000)).select("announcement_id", "attachment_id", "document_id", "parse_status")


@query("SELECT l_orderkey AS announcement_id, l_linenumber AS line, l_returnflag AS flag, l_partkey AS part, CASE WHEN l_returnflag = 'N' THEN (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 10 = l_orderkey % 10) ELSE l_orderkey % 10 END AS document_id FROM lineitem WHERE l_orderkey < 500")
def evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    proof = load(spark, sf, "lineitem").where("l_orderkey < 500").selectExpr("l_orderkey AS announcement_id", "l_linenumber AS line", "l_returnflag AS flag", "l_partkey AS part", "IF(l_returnflag = 'N', NULL, 'file') AS source_file")
    keys = load(spark, sf, "orders").where("o_orderkey < 500").selectExpr("o_orderkey AS announcement_id", "o_orderkey % 10 AS m")
    s = load(spark, sf, "supplier")
    bodies = keys.join(s.selectExpr("s_suppkey % 10 AS m", "s_suppkey AS document_id"), "m").selectExpr("announcement_id", "CAST(NULL AS STRING) AS attachment_id", "CAST(NULL AS STRING) AS source_file", "document_id")
    files = keys.selectExpr("announcement_id", "'a' AS attachment_id", "'file' AS source_file", "m AS document_id")
    return runs.latest_parse(proof, bodies.unionByName(files)).select("announcement_id", "line", "flag", "part", "document_id")


@query("SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE s_name END AS source_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS last_success FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0")
def source_seeding(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    old = s.where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS source_id", "'old' AS source_name", "s_acctbal AS last_success")
    return runs.seeded_sources(old, s.where("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS source_id", "s_name AS source_name"))


@query("SELECT s_suppkey AS task_id, (CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS result_count, CASE WHEN s_suppkey % 5 = 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM supplier")
def verification_runs(spark: SparkSession, sf: str) -> DataFrame:
    s, k = load(spark, sf, "supplier"), F.col("s_suppkey")
    tasks = s.select(k.alias("task_id"), k.alias("project_id"), F.array("s_name", F.concat("s_name", F.lit(" b")), "s_name").alias("queries"))
    page = lambda q, place, url, when, error=None: s.where(when).select(q.alias("query_text"), F.lit(place).alias("place"), F.lit(url).alias("url"), F.lit("t").alias("title"), F.lit(error).cast("string").alias("error"))
    name = F.col("s_name")
    index = page(name, 1, "u", "true").unionByName(page(name, 2, "u", "true")).unionByName(page(name, 3, "v", "s_suppkey % 3 = 0")).unionByName(page(F.concat(name, F.lit(" b")), 1, "u", "s_suppkey % 4 = 0")).unionByName(page(F.concat(name, F.lit(" b")), 1, "w", "s_suppkey % 5 = 0", "timeout")).unionByName(page(name, 9, "far", "true"))
    return runs.verification_run(tasks, index)[0].select("task_id", "result_count", "status")


@query("SELECT o_orderkey AS project_id, r AS reason FROM orders, (SELECT unnest(['a', 'b']) AS r) WHERE o_orderkey % 4 = 0 OR r = 'a' OR o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'a' FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 3 = 0")
def verification_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o, k = load(spark, sf, "orders"), F.col("o_orderkey").alias("project_id")
    pending = o.where("o_orderkey % 4 = 0").select(k, F.lit("a").alias("reason"), F.lit("RUNNING").alias("status")).unionByName(o.where("o_orderkey % 4 = 1 AND o_orderkey % 3 = 0").select(k, F.lit("a").alias("reason"), F.lit("COMPLETED").alias("status")))
    wanted = o.select(k, F.when((F.col("o_orderkey") % 2 == 0) | (F.col("o_orderkey") % 3 == 0), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("reasons"))
    return runs.verification_tasks(pending, wanted).select("project_id", "reason")


@query("SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN o_orderkey % 3 = 0 THEN 'doc1' END AS owner, CASE WHEN o_orderkey % 6 = 3 OR o_orderkey % 6 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS quality, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 THEN 'owner' ELSE '' END AS missing, o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 AS needs_review FROM orders")
def extraction_merge(spark: SparkSession, sf: str) -> DataFrame:
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    times = {f: F.lit(None).cast("timestamp_ntz") for f in ("qualification_start", "qualification_deadline", "registration_start", "registration_deadline", "document_start", "document_deadline", "bid_deadline", "open_time")}
    base = o.select(k.alias("notice_id"), F.when(k % 2 == 0, "own").otherwise("").alias("owner"), F.lit(0.5).alias("quality")).withColumns(times)
    docs = o.where("o_orderkey % 3 = 0").select(k.alias("notice_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("document_id")).withColumns({"owner": F.concat(F.lit("doc"), "document_id"), "quality": F.lit(0.9)})
    return runs.merged_extractions(base, docs, ["owner"], ["owner"], now()).select("notice_id", "owner", "quality", F.array_join("missing", ",").alias("missing"), "needs_review")


@query("""WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
  SELECT id FROM a WHERE NOT (id % 2 = 0 AND id % 11 = 0)""")
def extraction_cache(spark: SparkSession, sf: str) -> DataFrame:
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    notes = o.select(k.alias("id"), F.lit("h").alias("content_hash"), F.when(k % 13 == 0, None).when(k % 5 == 0, "other").otherwise("h").alias("snapshot_hash"), F.when(k % 3 == 0, "FAILED").otherwise("SUCCESS").alias("extraction_status"), F.lit("v2").alias("extraction_version"))
    notes = notes.withColumn("snapshot_hash", F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("snapshot_hash")))
    parse = lambda when, attachment, h: o.where(when).select(k.alias("announcement_id"), attachment.alias("attachment_id"), h.alias("content_hash"), F.lit("p").alias("source_file"), F.lit("d1").alias("parser_version"), F.lit("SUCCESS").alias("parse_status"))
    bodies = parse("o_orderkey % 7 <> 0", F.lit(None).cast("string"), F.lit("h"))
    files = parse("o_orderkey % 2 = 0", F.lit("a"), F.when(k % 11 == 0, "stale").otherwise("b"))
    attached = o.where("o_orderkey % 2 = 0").select(F.lit("a").alias("id"), k.alias("announcement_id"), F.lit("b").alias("content_hash"), F.lit("/x/f.PDF").alias("local_path"))
    return runs.cached(notes, bodies.unionByName(files), attached, "v2", "d1")


@query("SELECT p_partkey AS project_id, min(p_partkey) OVER (PARTITION BY p_size % 7) AS canonical_id FROM part WHERE p_size % 7 < 6 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_size % 7 = 6")
def code_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of equal size are tied by one code, sizes that differ by seven by another, so that chains join them."""
    rows = load(spark, sf, "part").selectExpr("p_partkey AS project_id", "IF(p_size % 7 < 6, concat('t-', p_size), NULL) AS tender_code", "IF(p_size % 7 < 6, concat('P ', p_size % 7), '') AS project_code")
    return runs.merged_codes(rows)


@query("SELECT o_orderkey AS project_id, o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_attachment, o_orderkey % 3 = 0 AS has_evidence FROM orders")
def presence(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id")
    return findings.with_presence(o, load(spark, sf, "lineitem").where("l_orderkey % 2 = 0").selectExpr("l_orderkey AS project_id"), o.where("project_id % 3 = 0"))


@query("""SELECT c_custkey AS id, 'https://' || CASE c_custkey % 4 WHEN 0 THEN 'www.x.gov.cn' WHEN 1 THEN 'mp.weixin.qq.com' WHEN 2 THEN 'news.bjx.cn' ELSE 'site.cn' END || '/a/' || c_custkey AS canonical_url, CASE WHEN c_custkey % 4 = 0 THEN 'A' WHEN c_custkey % 4 = 1 THEN 'B' WHEN c_custkey % 5 = 0 THEN 'C' WHEN c_custkey % 4 = 2 THEN 'D' ELSE 'E' END AS source_level,
  CASE c_custkey % 3 WHEN 0 THEN 'PROJECT_LEVEL_EPC' WHEN 1 THEN 'EARLY_STAGE_TRACKING' END AS lead_type, c_custkey % 3 < 2 AS is_candidate, c_custkey % 4 = 0 AS is_official, c_custkey % 3 < 2 AND c_custkey % 4 <> 0 AS is_secondary, 'P' || c_custkey AS project_code FROM customer""")
def findings_of_results(spark: SparkSession, sf: str) -> DataFrame:
    k = "c_custkey"
    host = f"CASE {k} % 4 WHEN 0 THEN 'www.x.gov.cn' WHEN 1 THEN 'mp.weixin.qq.com' WHEN 2 THEN 'news.bjx.cn' ELSE 'site.cn' END"
    what = f"CASE {k} % 3 WHEN 0 THEN '光伏项目EPC招标' WHEN 1 THEN '风电项目可研' ELSE '道路养护' END"
    rows = load(spark, sf, "customer").selectExpr(f"{k} AS id", f"explode(array('?utm_x=1', '#top')) AS tail", f"concat('http://', {host}, '/a/', {k}) AS u", f"concat({what}, IF({k} % 5 = 0, ' 招标代理', '')) AS title", "c_mktsegment AS snippet", f"map('projectnum', concat('P', {k})) AS metadata")
    return findings.findings(rows.withColumn("url", F.concat("u", "tail")).drop("u", "tail")).select("id", "canonical_url", "source_level", "lead_type", "is_candidate", "is_official", "is_secondary", "project_code")


@query("SELECT c_custkey, '项目' || c_custkey || '号|T-10' || c_custkey || '|' || '公司' || c_nationkey AS found, 'T-10' || c_custkey AS codes, '公司' || c_nationkey AS owner FROM customer")
def snippet_queries(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("concat('项目名称：项目', c_custkey, '号，招标编号: T-10', c_custkey, '。招标人：公司', c_nationkey, '；')")
    rows = load(spark, sf, "customer").select("c_custkey", text.alias("t"))
    return rows.select("c_custkey", F.array_join(findings.snippet_queries(F.col("t")), "|").alias("found"), F.array_join(L.lead_codes(F.col("t")), "|").alias("codes"), L.lead_owner(F.col("t")).alias("owner"))


@query("SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END::INT AS n_missing, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey END AS owner FROM orders")
def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS candidate_id", "IF(o_orderkey % 3 = 0, 'broken[', '[\"a\", \"b\"]') AS missing_fields_json", "IF(o_orderkey % 2 = 0, concat('{\"owner\": \"v', o_orderkey, '\"}'), NULL) AS candidate_values_json")
    return findings.candidate_rows(rows).select("candidate_id", F.size("missing_fields").alias("n_missing"), F.try_element_at("candidate_values", F.lit("owner")).alias("owner"))


@query("SELECT l_orderkey AS candidate_id, l_returnflag AS field_name, lower(l_linestatus) AS value, count(*) >= 1 AS kept FROM lineitem GROUP BY 1, 2, 3")
def candidate_fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda when, value: load(spark, sf, "lineitem").where(when).selectExpr("l_orderkey AS candidate_id", "l_returnflag AS field_name", f"{value} AS value")
    old = rows("l_linenumber <= 2", "lower(l_linestatus)").distinct()
    made = runs.facts_added(old, rows("l_linenumber > 2", "concat(' ', l_linestatus, ' ')"))
    return made.select("candidate_id", "field_name", F.lower(F.trim("value")).alias("value"), F.lit(True).alias("kept"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '&amp;', '&'), '\s+', ' ', 'g'), ' :：;；,，') AS title FROM pages""")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


@query()
def html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Title and main text of whole pages; entities and blocks are beyond SQL, so tests hold it against a parser."""
    return spread(load(spark, sf, "pages")).select("page_id", H.page_title(F.col("html")).alias("title"), H.main_text(F.col("html")).alias("text"))


_TABLE = "'<table><tr><th>项目名称</th><td>' || c_name || '</td><td>预算金额</td><td>' || c_custkey || '万元</td></tr><tr><td></td></tr><tr><td>招标人</td><td> a &amp; b </td></tr><tr><td>项目名称</td><td>other</td></tr></table>'"


@query("SELECT c_custkey, c_name AS projectname, c_custkey || '万元' AS budget, 'a & b' AS tenderer, 3::INT AS n_rows FROM customer")
def table_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").selectExpr("c_custkey", f"{_TABLE} AS html").select("c_custkey", H.table_metadata(F.col("html")).alias("m"), F.size(H.table_rows(F.col("html"))).alias("n_rows"))
    return rows.select("c_custkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("projectname", "budget", "tenderer")], "n_rows")


@query("SELECT s_suppkey AS page, 'https://h.cn/list/n' || i || '.html' AS url, s_name || ' ' || i AS title, TIMESTAMP '2026-08-01 17:00:00' + to_days(i::INT) AS published_at FROM supplier, (SELECT unnest([1, 2]) AS i)")
def landed_list(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda i: f"concat('<li class=\"row x\"><a href=\"n{i}.html\"><b>', s_name, '</b> {i}</a><span class=\"date\">2026-08-0{1 + i}</span></li>')"
    rows = load(spark, sf, "supplier").selectExpr("s_suppkey AS page", "'https://h.cn/list/index.html?p=1' AS url", f"concat('<ul>', {item(1)}, {item(2)}, {item(1)}, '<li>other</li></ul>') AS html")
    found = H.list_items(rows, "page", "url", "html", H.ListPage(item_class="row", date_class="date"), 2026)
    return found.select("page", "url", F.regexp_replace("title", " 2026-.*$", "").alias("title"), "published_at")


@query("SELECT s_suppkey AS page, u AS url, n AS file_name FROM supplier, (SELECT unnest(['https://h.cn/f/a b.pdf', 'https://h.cn/d/attach/7', 'https://h.cn/x/y.docx']) AS u, unnest(['a b.pdf', '7', 'y.docx']) AS n)")
def attachments_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    html = "<a href=\"/f/a b.pdf\">one</a><a href='javascript:go()'>no</a><a href=\"attach/7\">two</a><a onclick=\"down('/x/y.docx')\" href=\"#\">three</a><a href=\"page.html\">no</a>"
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), F.lit("https://h.cn/d/p.html").alias("url"), F.lit(html).alias("html"))
    return H.attachment_links(rows, "page", "url", "html")


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || '|list[0].a: x|list[1]: 2' AS lines FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "list": [{"a": "x"}, 2]}'))
    return load(spark, sf, "events").select("event_id", F.array_join(H.json_lines(text), "|").alias("lines"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.bin' END AS stored, CASE page_id % 3 WHEN 0 THEN '.doc' ELSE '' END AS named, 'a_b ' || page_id AS safe FROM pages")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 3
    mime, url = F.when(k == 0, "application/pdf; x").when(k == 1, "TEXT/HTML").otherwise("x/y"), F.when(k == 0, "http://a/b.DOC?x.pdf").otherwise("http://a/b")
    return load(spark, sf, "pages").select("page_id", H.suffix_of(mime, url).alias("stored"), H.suffix_of(F.when(k == 0, mime), url, names_first=True).alias("named"), H.safe_filename(F.concat(F.lit(" ａ/b  "), "page_id", F.lit(". "))).alias("safe"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1998-05-06 17:00:00' WHEN 1 THEN '1200.50' ELSE 'text' END AS value FROM orders")
def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    field = F.when(k == 0, "bid_deadline").when(k == 1, "budget").otherwise("owner")
    value = F.when(k == 0, "1998年5月6日").when(k == 1, " 1,200.5").otherwise(" text ")
    return load(spark, sf, "orders").select("o_orderkey", runs.coerced(field, value, 1998).alias("value"))


@query(f"""WITH {PROJECTS} SELECT project_id, CASE WHEN project_id % 2 = 0 THEN '1,2' ELSE '1' END AS document_ids, CASE WHEN project_id % 2 = 0 THEN 'f1,f2,z' ELSE 'f1,z' END AS paths, CASE WHEN rd IS NULL THEN 'registration_deadline' ELSE '' END AS missing_fields, CASE WHEN bid IS NOT NULL AND project_id % 3 <> 0 THEN 'bid_deadline' ELSE '' END AS missing_evidence FROM projects""")
def review_payload(spark: SparkSession, sf: str) -> DataFrame:
    p = projects(spark, sf)
    k = F.col("project_id")
    notes = p.where("project_id % 2 = 0").select("project_id", k.alias("id"))
    none = F.lit(None).cast("long")
    parses = p.select("project_id", none.alias("announcement_id"), F.lit(1).alias("document_id"), F.lit("f1").alias("file_path")).unionByName(p.select(none.alias("project_id"), k.alias("announcement_id"), F.lit(2).alias("document_id"), F.lit("f2").alias("file_path")))
    attached = p.select("project_id", F.lit("z").alias("local_path"))
    proof = p.where("project_id % 3 = 0").select("project_id", F.lit("bid_deadline").alias("field_name"), F.lit(2).alias("strength"))
    rows = findings.review_payload(p, notes, parses, attached, proof, ["registration_deadline"], ["bid_deadline"], 2)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("project_id", join("document_ids").alias("document_ids"), join("paths").alias("paths"), join("missing_fields").alias("missing_fields"), join("missing_evidence_fields").alias("missing_evidence"))


@query("SELECT s_suppkey AS source, 'https://h.cn/new/' || s_suppkey || '/' || i AS url, s_name || ' ' || i AS title, TIMESTAMP '2026-08-01 17:00:00' + to_days(i::INT) AS published_at FROM supplier, (SELECT unnest([1, 2]) AS i) WHERE s_suppkey % 3 <> 0")
def connector_items(spark: SparkSession, sf: str) -> DataFrame:
    """Search answers of two pages, whose envelopes differ; the second page repeats an item. Every third is broken."""
    from tidemark.operators.landing import Connector, listed_items

    item = lambda i: f"concat('{{\"t\": \"<b>', s_name, '</b> {i}\", \"u\": \"/old/', s_suppkey, '/{i}\", \"d\": \"2026-08-0{1 + i}\"}}')"
    s = load(spark, sf, "supplier")
    one = s.selectExpr("1 AS page", "'x' AS url", f"IF(s_suppkey % 3 = 0, '{{broken', concat('{{\"data\": {{\"records\": [', {item(1)}, ']}}}}')) AS body")
    two = s.selectExpr("2 AS page", "'x' AS url", f"IF(s_suppkey % 3 = 0, '', concat('{{\"result\": [', {item(1)}, ',', {item(2)}, ']}}')) AS body")
    c = Connector("s", base_url="https://h.cn/", fields={"title": ("x", "t"), "url": ("u",), "published_at": ("d",)}, rewrite=("/old/", "/new/"))
    found = listed_items(one.unionByName(two), c, 2026)
    return found.select(F.regexp_extract("url", "/new/([0-9]+)/", 1).cast("long").alias("source"), "url", "title", "published_at")


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 17 = 0 OR (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 300 DAY AND (o_orderkey % 5 > 1 OR o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 11 DAY))")
def incremental_items(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.landing import since

    items = load(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 5 AS source_id", "IF(o_orderkey % 17 = 0, NULL, o_orderdate) AS published_at")
    state = load(spark, sf, "region").selectExpr("r_regionkey AS source_id", f"IF(r_regionkey < 2, TIMESTAMP_NTZ '{NOW}' - INTERVAL 10 DAYS, NULL) AS last_success_at")
    return since(items, state, now(), 300).select("id")


@query("SELECT o_orderkey AS project_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 29 <> 0 AND o_orderdate + INTERVAL 60 DAY >= TIMESTAMP '1998-01-01'")
def changed_today(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.landing import project_list

    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", "CASE o_orderstatus WHEN 'F' THEN 'OPEN' WHEN 'O' THEN 'CLOSED' ELSE 'UNKNOWN' END AS status", "o_orderdate + make_dt_interval(60) AS last_change_at", "o_orderdate AS created_at", "'NEW' AS lifecycle_state", "false AS favorite", "IF(o_orderkey % 29 = 0, true, NULL) AS ignored")
    return project_list(rows, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), status="open", view="today-changed").select("project_id")


@query("SELECT token, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(concat_ws(' ', lang, source)), '[^a-z0-9_]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.landing import token_table

    rows = load(spark, sf, "documents").selectExpr("doc_id AS project_id", "lang AS owner", "source AS agency")
    none = spark.createDataFrame([], "project_id long, id int, published_at timestamp_ntz, clean_text string")
    return token_table(rows, none, ["owner", "agency"]).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS candidate_id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END NULLS LAST, o_totalprice DESC, o_orderdate DESC, o_orderkey)::INT AS place FROM orders ORDER BY place LIMIT 100")
def enrichment_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred candidates in the order in which they are enriched."""
    from pyspark.sql import Window

    from tidemark.operators.recall import queue_order

    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS candidate_id", "IF(o_orderkey % 3 = 0, NULL, o_orderkey % 5) AS review_priority", "o_totalprice AS rank_score", "o_orderdate AS updated_at")
    top = rows.orderBy(*queue_order()).limit(100)
    return top.select("candidate_id", F.row_number().over(Window.orderBy(*queue_order())).alias("place"))


@query("""SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 15 + CASE WHEN o_orderkey % 4 <> 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 5 ELSE 0 END + 10 + 5 + 3 + 2 END::INT AS score, CASE WHEN o_orderkey % 7 = 0 THEN 'BLOCKED' ELSE 'PARTIAL' END AS state FROM orders""")
def closed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose documents are the written notices; every seventh can't be read."""
    from tidemark.operators.landing import document_closure
    from tidemark.plans.notices import written_notices

    notes = written_notices(spark, sf)
    documents = notes.select(F.col("project_id").alias("candidate_id"), "url", "title", "text", F.when(F.col("project_id") % 7 == 0, "BROKEN_DOCUMENT").alias("error"))
    candidates = load(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.lit(None).cast("map<string,string>").alias("candidate_values"), F.lit(None).cast("string").alias("blocker"))
    facts = spark.createDataFrame([], "candidate_id long, field_name string, value string")
    out, _ = document_closure(candidates, documents, facts, 1998, now())
    return out.select("candidate_id", F.col("completeness_score").cast("int").alias("score"), F.col("enrichment_state").alias("state"))
