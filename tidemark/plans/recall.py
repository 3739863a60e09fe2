"""Queries of recall, delivery and measures, bound to the driver's tables: orders are projects, line items their announcements."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import matching, metrics, recall
from tidemark.plans.bindings import NOW, PROJECTS, evidence, load, projects
from tidemark.plans.catalog import now, query

CRITERIA = recall.Criteria(
    low="1997-01-01 00:00:00", high="1997-06-30 00:00:00", province="ASIA", announcement_types=("N", "R"), terms=("machinery", "urgent"), excluded=("low",), source_level="C", delta=True,
    relevance=partial(rules.relevance, direct=["building"], component=["zzz"], structure=["automobile"], parent=["furniture"], contract=["medium"], procurement=["high"]),
)
LEVEL = "substr('ABCDE', CAST(substr(o_orderpriority, 1, 1) AS INT), 1)"


def placed_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Projects with a place, a name, a source level and marks."""
    c, n, r = load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region")
    where = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "c_name", "c_mktsegment", F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    p = projects(spark, sf)
    return p.join(where, p.o_custkey == where.c_custkey).selectExpr(
        *[c for c in p.columns if not c.startswith("o_")], "o_totalprice", "province", "city", "concat(c_mktsegment, ' ', o_orderpriority) AS project_name", "c_name AS owner", "project_id % 29 = 0 AS ignored", f"{LEVEL} AS source_level",
        "publish_time + make_dt_interval(60) AS last_change_at", "CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'F' THEN 'UPDATED' ELSE 'REOPENED' END AS lifecycle_state", "CAST(project_id % 101 AS DOUBLE) AS completeness_score",
    )


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr("l_orderkey AS project_id", "l_linenumber AS id", "l_shipdate AS published_at", "l_returnflag AS announcement_type", "concat('line ', l_linestatus) AS clean_text")


def pool(spark: SparkSession, sf: str) -> DataFrame:
    prior = load(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS project_id", "IF(o_orderkey % 6 = 0, 'DIRECT', 'IRRELEVANT') AS relevance_class", "o_orderdate AS updated_at")
    return recall.recall(placed_projects(spark, sf), notes(spark, sf), evidence(spark, sf), CRITERIA, now(), prior)


_POOL = f"""{PROJECTS},
newest AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC, l_linestatus DESC) AS k FROM lineitem) WHERE k = 1),
texts AS (SELECT r.*, n_name AS city, r_name AS province, {LEVEL} AS source_level, l_linenumber AS announcement_id, coalesce(l_returnflag, '') AS kind, lower(concat_ws(' ', c_mktsegment || ' ' || o_orderpriority, 'line ' || l_linestatus)) AS t
  FROM reasons r JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN newest ON l_orderkey = project_id
  WHERE project_id % 29 <> 0 AND r_name = 'ASIA' AND coalesce(l_returnflag, '') IN ('N', 'R')
    AND (publish_time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = project_id AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'))),
classed AS (SELECT *, list_filter(['machinery', 'urgent'], lambda x: contains(t, x)) AS found, CASE WHEN contains(t, 'low') THEN ['EXCLUDED:low'] ELSE CAST([] AS VARCHAR[]) END AS marks,
    CASE WHEN contains(t, 'building') AND contains(t, 'high') THEN 'DIRECT' WHEN contains(t, 'furniture') AND contains(t, 'medium') THEN 'EMBEDDED' WHEN contains(t, 'automobile') THEN 'STRUCTURAL_RELATED'
      WHEN contains(t, 'furniture') THEN 'PARENT_PROJECT' WHEN contains(t, 'high') THEN 'POSSIBLE' ELSE 'IRRELEVANT' END AS relevance_class FROM texts),
pool AS (SELECT *, list_concat(found, marks) AS matched, split_part(reason_code, '_', 1) AS status FROM classed WHERE len(found) > 0 OR relevance_class <> 'IRRELEVANT' OR project_id % 6 = 0)"""


@query(f"WITH {_POOL} SELECT project_id, announcement_id, array_to_string(matched, ',') AS matched, relevance_class, status, reason_code FROM pool")
def recall_projects(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).select("project_id", "announcement_id", F.array_join("matched", ",").alias("matched"), "relevance_class", "status", "reason_code")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    sessions = load(spark, sf, "region").selectExpr("r_regionkey AS session_id", "IF(r_regionkey < 4, 'k', 'other') AS scope_key", "IF(r_regionkey = 3, 'FAILED', 'COMPLETED') AS status", "TIMESTAMP_NTZ '1997-05-01 00:00:00' AS started_at", "IF(r_regionkey = 0, NULL, TIMESTAMP_NTZ '1997-07-01 00:00:00') AS finished_at")
    o = load(spark, sf, "orders")
    link = lambda k: o.selectExpr(f"o_orderkey % {k} AS session_id", "o_orderkey AS project_id", f"CAST(o_orderkey % {k} + 1 AS INT) AS announcement_id", "IF(o_orderkey % 2 = 0, 'CLOSED', 'UNKNOWN') AS status_at_search")
    return recall.last_reports(sessions, link(7).unionByName(link(5)), "k", -1)


_REPORTS = """
sessions AS (SELECT r_regionkey AS s, CASE WHEN r_regionkey = 0 THEN TIMESTAMP '1997-05-01' ELSE TIMESTAMP '1997-07-01' END AS seen FROM region WHERE r_regionkey < 3),
links AS (SELECT o_orderkey % 7 AS s, o_orderkey AS p, o_orderkey % 7 + 1 AS a FROM orders UNION ALL SELECT o_orderkey % 5, o_orderkey, o_orderkey % 5 + 1 FROM orders),
reports AS (SELECT p, seen, list_distinct(list(a)) AS ids, CASE WHEN p % 2 = 0 THEN 'CLOSED' ELSE 'UNKNOWN' END AS was FROM (SELECT p, a, seen, max(seen) OVER (PARTITION BY p) AS top FROM links JOIN sessions USING (s)) WHERE seen = top GROUP BY 1, 2)"""


@query(f"""WITH {_POOL},{_REPORTS},
  same AS (SELECT project_id FROM pool JOIN reports ON p = project_id LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS linked FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = project_id
    WHERE NOT (publish_time + INTERVAL 60 DAY > seen OR status <> was OR coalesce(NOT list_contains(ids, announcement_id), false) OR coalesce(linked > seen, false) OR (project_id % 11 = 0 AND publish_time + INTERVAL 30 DAY > seen)))
  SELECT project_id, status FROM pool WHERE source_level <= 'C' AND NOT contains(array_to_string(matched, ','), 'EXCLUDED:') AND project_id NOT IN (SELECT project_id FROM same)""")
def delivery(spark: SparkSession, sf: str) -> DataFrame:
    held = pool(spark, sf)
    links = load(spark, sf, "lineitem").where("l_returnflag = 'A'").selectExpr("l_orderkey AS project_id", "l_shipdate AS first_seen_at")
    manual = load(spark, sf, "orders").where("o_orderkey % 11 = 0").selectExpr("o_orderkey AS project_id", "o_orderdate + make_dt_interval(30) AS changed_at")
    same = recall.unchanged(held, _reports(spark, sf), links, manual)
    return recall.deliver(held, CRITERIA, same).select("project_id", "status")


@query(f"WITH {_REPORTS.lstrip()} SELECT p AS project_id, seen AS reported_at, was AS status_at_search, array_to_string(list_sort(ids), ',') AS announcement_ids FROM reports")
def last_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("project_id", "reported_at", "status_at_search", F.array_join(F.transform(F.array_sort("announcement_ids"), lambda x: x.cast("string")), ",").alias("announcement_ids"))


@query("SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderdate + INTERVAL 60 DAY >= TIMESTAMP '1998-01-01')")
def lone_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS candidate_id", "IF(o_orderkey % 4 = 0, o_orderkey, NULL) AS project_id", "o_orderdate AS first_seen_at", "o_orderdate + make_dt_interval(60) AS last_change_at")
    return recall.delivered_candidates(rows, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), True).select("candidate_id")


@query(f"""WITH {PROJECTS}, r AS (SELECT *, least(qd, rd, dd, bid, opened) AS next FROM reasons JOIN customer ON o_custkey = c_custkey)
  SELECT project_id, CASE WHEN project_id % 4 = 0 THEN 0 WHEN project_id % 4 = 1 THEN 1 ELSE 2 END::INT AS source_count, CASE WHEN project_id % 4 <> 0 THEN 'u' || project_id % 3 END AS best_source_url, 9::INT AS n_evidence,
    array_to_string(list_filter(['bid_deadline', 'document_deadline', 'open_time', 'qualification_deadline', 'registration_deadline'], lambda f: (project_id + CASE f WHEN 'bid_deadline' THEN 6 WHEN 'document_deadline' THEN 5 WHEN 'open_time' THEN 7 WHEN 'qualification_deadline' THEN 1 ELSE 3 END) % 61 <> 0 AND (project_id + CASE f WHEN 'bid_deadline' THEN 6 WHEN 'document_deadline' THEN 5 WHEN 'open_time' THEN 7 WHEN 'qualification_deadline' THEN 1 ELSE 3 END) % 67 <> 0), ',') AS critical,
    round(epoch(next - TIMESTAMP '{NOW}') / 3600.0, 2)::DOUBLE AS remaining_hours, o_orderstatus = 'O' AS is_new, r_name || ' / ' || n_name AS matched_region
  FROM r JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def project_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = placed_projects(spark, sf)
    link = lambda k, when: load(spark, sf, "orders").where(when).selectExpr("o_orderkey AS project_id", f"concat('s', o_orderkey % 3 + {k}) AS source_id", f"IF({k} = 0, concat('u', o_orderkey % 3), NULL) AS source_url")
    links = link(0, "o_orderkey % 4 <> 0").unionByName(link(1, "o_orderkey % 4 > 1"))
    sources = load(spark, sf, "supplier").where("s_suppkey < 4").selectExpr("concat('s', s_suppkey) AS source_id", "s_name AS source_name", "concat('b', s_suppkey) AS base_url")
    proof = evidence(spark, sf).withColumn("id", F.xxhash64("project_id", "field_name"))
    rows = recall.compact(p, links, sources, proof, now())
    return rows.select("project_id", F.col("source_count").cast("int").alias("source_count"), "best_source_url", F.size("evidence_ids").alias("n_evidence"), F.array_join("critical_evidence_fields", ",").alias("critical"), "remaining_hours", "is_new", "matched_region")


@query(f"WITH {PROJECTS} SELECT project_id, row_number() OVER (ORDER BY CASE split_part(reason_code, '_', 1) WHEN 'OPEN' THEN 0 WHEN 'UNKNOWN' THEN 1 ELSE 2 END, least(qd, rd, dd, bid, opened) NULLS LAST, {LEVEL}, publish_time DESC NULLS LAST, project_id % 101 DESC, project_id)::INT AS place FROM reasons JOIN customer ON o_custkey = c_custkey ORDER BY place LIMIT 100")
def presented(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred projects as a user sees them."""
    from pyspark.sql import Window

    p = placed_projects(spark, sf)
    from tidemark.operators.core import recalculate_status

    rows = p.join(recalculate_status(projects(spark, sf), evidence(spark, sf), now()), "project_id")
    top = rows.orderBy(*recall.presentation_order()).limit(100)
    return top.select("project_id", F.row_number().over(Window.orderBy(*recall.presentation_order())).alias("place"))


@query("SELECT o_orderkey AS project_id, 'x' || o_orderkey AS project_name, c_name AS owner, CASE WHEN o_orderkey % 3 <> 0 THEN 'loc' ELSE r_name || ' / ' || n_name END AS location, CASE WHEN o_orderkey % 2 = 0 THEN 'big' ELSE o_orderpriority END AS scope FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def candidate_facts(spark: SparkSession, sf: str) -> DataFrame:
    p = placed_projects(spark, sf).selectExpr("project_id", "province", "city", "concat('x', project_id) AS project_name", "'' AS owner", "owner AS tenderer", "IF(project_id % 3 <> 0, 'loc', NULL) AS location", "IF(project_id % 2 = 0, 'big', '') AS project_scale", "substring(project_name, instr(project_name, ' ') + 1) AS project_type")
    v = p.select("project_id", recall.candidate_values(p).alias("v"))
    return v.select("project_id", *[F.try_element_at("v", F.lit(k)).alias(n) for n, k in (("project_name", "project_name"), ("owner", "owner"), ("location", "project_location"), ("scope", "scope"))])


@query("""SELECT o_orderkey AS project_id, least(100, 15 + 10 + 5 + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 7 <> 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 11 <> 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 THEN 5 ELSE 0 END
  + CASE WHEN o_orderpriority LIKE '1-%' THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN o_orderkey % 5 <> 0 THEN 2 ELSE 0 END)::INT AS score FROM orders""")
def completeness_score(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    values = {"project_name": F.lit("x"), "owner": c("o_custkey"), "publish_time": c("publish_time"), "project_code": F.when(c("project_id") % 2 == 0, "c"), "document_deadline": c("document_deadline"), "bid_deadline": c("bid_deadline"), "open_time": c("open_time"), "participation_method": F.when(c("has_marker"), "m"), "scope": F.lit(" ")}
    return projects(spark, sf).select("project_id", metrics.completeness(values, c("project_id") % 4 == 0, c("project_id") % 5 != 0).alias("score"))


@query("""WITH e AS (SELECT l_orderkey AS p, round(avg(l_linenumber / 10.0::DOUBLE)::DECIMAL(18, 10), 4)::DOUBLE AS f FROM lineitem GROUP BY 1),
  j AS (SELECT o_orderkey, coalesce(f, 0.0::DOUBLE) AS f, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.85::DOUBLE WHEN '3' THEN 0.7::DOUBLE WHEN '4' THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END AS m FROM orders LEFT JOIN e ON p = o_orderkey)
  SELECT o_orderkey AS project_id, f AS field_confidence, s AS source_confidence, m AS match_confidence, floor((f * 0.55::DOUBLE + s * 0.3::DOUBLE + m * 0.15::DOUBLE) * 100 + 0.01)::INT AS overall_percent FROM j""")
def confidence_blend(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", f"{LEVEL} AS source_level", "IF(o_orderkey % 3 = 0, 't', '') AS tender_code", "CAST(NULL AS STRING) AS project_code")
    e = load(spark, sf, "lineitem").selectExpr("l_orderkey AS project_id", "l_linenumber / CAST(10 AS DOUBLE) AS confidence")
    # in whole percents: engines round ties of the fourth place differently
    return metrics.confidences(p, e).select("project_id", "field_confidence", "source_confidence", "match_confidence", F.floor(F.col("overall_confidence") * 100 + 0.01).cast("int").alias("overall_percent"))


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 5 IN (0, 1) OR o_orderkey % 13 = 0 AS official, o_orderkey % 5 = 2 OR o_orderkey % 17 = 0 AS secondary, ['COMPLETE', 'USABLE', 'PARTIAL', 'BLOCKED', 'EXHAUSTED'][o_orderkey % 5 + 1] AS state, (o_orderkey % 101)::DOUBLE AS score FROM orders)
  SELECT count(*) AS candidate_recall, count_if(secondary)::BIGINT AS secondary_candidates, count_if(official)::BIGINT AS official_verified_count, count_if(k % 5 = 1 OR k % 4 >= 2)::BIGINT AS multi_source_confirmed_count, count_if(state IN ('USABLE', 'COMPLETE'))::BIGINT AS usable_count,
    count_if(state = 'PARTIAL')::BIGINT AS partial_count, count_if(state = 'BLOCKED')::BIGINT AS blocked_count, count_if(state = 'EXHAUSTED')::BIGINT AS exhausted_count, round(count_if(k % 9 <> 0) / count(*), 4) AS candidate_precision, round(count_if(official) / count(*), 4) AS official_verification_rate,
    round(count_if(state IN ('USABLE', 'COMPLETE')) / count(*), 4) AS enrichment_success_rate, round(avg(score), 2) AS completeness_average, count_if(score >= 85)::BIGINT AS complete_ge_85, count_if(score >= 60 AND score < 85)::BIGINT AS usable_60_84, count_if(score >= 30 AND score < 60)::BIGINT AS partial_30_59,
    count_if(score < 30)::BIGINT AS lead_lt_30, round(count_if(k % 3 = 0) / count(*), 4) AS critical_fact_coverage, count_if(secondary AND official)::BIGINT AS secondary_official_verified_count, count_if(secondary AND state IN ('USABLE', 'COMPLETE'))::BIGINT AS secondary_usable_count,
    round(count_if(secondary AND official) / count_if(secondary), 4) AS secondary_to_official_conversion_rate, round(count_if(secondary AND state IN ('USABLE', 'COMPLETE')) / count_if(secondary), 4) AS secondary_to_usable_rate,
    count_if(k % 2 = 0)::BIGINT AS n_open, count_if(k % 2 = 1)::BIGINT AS n_unknown, 0::BIGINT AS n_closed,
    (SELECT count(*) FROM supplier) AS source_target, (SELECT count_if(s_suppkey % 3 = 0 OR s_suppkey % 2 = 0) FROM supplier)::BIGINT AS source_attempted, (SELECT count_if(s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0) FROM supplier)::BIGINT AS source_successful, (SELECT round(count_if(s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0) / count(*), 4) FROM supplier) AS source_rate FROM c""")
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = "o_orderkey"
    candidates = load(spark, sf, "orders").selectExpr(
        f"CASE {k} % 5 WHEN 0 THEN 'official_verified' WHEN 1 THEN 'MULTI_SOURCE_CONFIRMED' WHEN 2 THEN 'SECONDARY_ONLY' END AS verification_status", f"{k} % 13 = 0 AS official_found", f"IF({k} % 17 = 0, 'SECONDARY_LEAD', NULL) AS candidate_class",
        f"{k} % 4 AS source_count", f"element_at(array('COMPLETE', 'USABLE', 'PARTIAL', 'BLOCKED', 'EXHAUSTED'), CAST({k} % 5 AS INT) + 1) AS enrichment_state", f"IF({k} % 9 = 0, 'IRRELEVANT', 'DIRECT') AS relevance_class", f"CAST({k} % 101 AS DOUBLE) AS completeness_score",
        f"IF({k} % 2 = 0, 'OPEN', NULL) AS tender_status", f"{k} % 3 = 0 AS critical",
    )
    sources = load(spark, sf, "supplier").selectExpr("s_suppkey % 3 = 0 AS selected", "IF(s_suppkey % 2 = 0, 'ACTIVE', 'ERROR') AS status", "IF(s_suppkey % 7 = 0, 'failed', '') AS error")
    return metrics.quality_metrics(candidates, sources)


_COVER = """planned AS (SELECT s_suppkey AS source_id, s_suppkey % 4 <> 0 AS selected, CASE WHEN s_suppkey % 9 = 0 THEN 'ADAPTER_NOT_CONFIGURED' WHEN s_suppkey % 10 = 0 THEN 'MANUAL_ACTION_REQUIRED' ELSE 'READY' END AS reason FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 9 = 0),
last AS (SELECT * FROM (SELECT l_suppkey, l_returnflag, CASE WHEN l_quantity < 3 THEN 'CAPTCHA' WHEN l_quantity > 40 THEN 'SUSPECT_ZERO_RESULTS' END AS health, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END DESC, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END DESC, health DESC NULLS LAST) AS k FROM lineitem WHERE l_suppkey % 8 <> 1) WHERE k = 1),
covered AS (SELECT coalesce(source_id, l_suppkey) AS source_id, CASE WHEN reason = 'ADAPTER_NOT_CONFIGURED' THEN 'ADAPTER_NOT_CONFIGURED' WHEN reason = 'MANUAL_ACTION_REQUIRED' THEN 'BLOCKED_BEFORE' WHEN source_id IS NOT NULL AND NOT selected THEN 'SKIPPED' WHEN source_id IS NOT NULL AND l_suppkey IS NULL THEN 'NOT_RETURNED'
    WHEN source_id IS NOT NULL AND health = 'CAPTCHA' THEN 'BLOCKED' WHEN l_returnflag = 'R' OR (source_id IS NOT NULL AND l_returnflag = 'A') THEN 'FAILED' WHEN source_id IS NOT NULL AND health = 'SUSPECT_ZERO_RESULTS' THEN 'SUSPECT_ZERO' ELSE 'SUCCESSFUL' END AS coverage,
    coalesce(selected, true) AS targeted FROM planned FULL JOIN last ON source_id = l_suppkey)"""


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    plan = load(spark, sf, "supplier").where("s_suppkey % 3 <> 0 OR s_suppkey % 9 = 0").selectExpr("s_suppkey AS source_id", "s_suppkey % 4 <> 0 AS selected", "CASE WHEN s_suppkey % 9 = 0 THEN 'ADAPTER_NOT_CONFIGURED' WHEN s_suppkey % 10 = 0 THEN 'MANUAL_ACTION_REQUIRED' ELSE 'READY' END AS reason")
    results = load(spark, sf, "lineitem").where("l_suppkey % 8 <> 1").selectExpr("l_suppkey AS source_id", "l_shipdate AS at", "IF(l_returnflag = 'R', 'failed', NULL) AS error", "IF(l_returnflag = 'A', 1, 0) AS failures", "CASE WHEN l_quantity < 3 THEN 'CAPTCHA' WHEN l_quantity > 40 THEN 'SUSPECT_ZERO_RESULTS' END AS health_reason", "false AS manual_action_required")
    return metrics.coverage(plan, results)


@query(f"WITH {_COVER} SELECT source_id, coverage, targeted, coverage IN ('BLOCKED', 'FAILED', 'SUSPECT_ZERO', 'SUCCESSFUL') AS attempted, coverage IN ('SUSPECT_ZERO', 'SUCCESSFUL') AS successful FROM covered")
def coverage_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _covered(spark, sf)


@query(f"WITH {_COVER}, n AS (SELECT count_if(targeted) AS t, count_if(coverage IN ('BLOCKED', 'FAILED', 'SUSPECT_ZERO', 'SUCCESSFUL')) AS a, count_if(coverage IN ('SUSPECT_ZERO', 'SUCCESSFUL')) AS s, count_if(coverage = 'SUSPECT_ZERO') AS z FROM covered) SELECT t::BIGINT AS target, a::BIGINT AS attempted, s::BIGINT AS successful, z::BIGINT AS suspicious, round(s / greatest(1, t), 4) AS coverage_rate, round(a / greatest(1, t), 4) AS execution_rate FROM n")
def coverage_rates(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.coverage_rates(_covered(spark, sf))


_NORM = r"lower(regexp_replace({}, '[\s\-—_()（）【】\[\]，。,.;；:：/\\]+', '', 'g'))"
_CASES = f"""cases AS (SELECT item_id, 'r' || item_id % 3 AS region, list_transform(string_split(text, '. '), lambda x: {_NORM.format("x")}) AS terms, item_id % 7 = 0 AS absent, CASE WHEN item_id % 11 = 0 THEN item_id END AS pid, item_id % 5 = 0 AS art, {_NORM.format("text")} AS whole FROM benchmark),
plain AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents),
hit AS (SELECT item_id, min(doc_id) AS doc_id FROM (SELECT item_id, doc_id FROM cases JOIN plain ON len(list_filter(terms, lambda x: NOT contains(t, x))) = 0 UNION ALL SELECT item_id, doc_id FROM cases JOIN plain ON pid = doc_id) GROUP BY 1),
judged AS (SELECT c.*, doc_id, CASE WHEN doc_id IS NOT NULL THEN 'database' WHEN art AND len(list_filter(terms, lambda x: NOT contains(whole, x))) = 0 THEN 'artifact' END AS how FROM cases c LEFT JOIN hit USING (item_id)),
states AS (SELECT *, CASE WHEN how IS NOT NULL THEN 'MATCHED' WHEN absent THEN 'UNAVAILABLE_IN_LOCAL_CORPUS' ELSE 'NOT_RECALLED' END AS status FROM judged)"""


def _recalled(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "benchmark")
    cases = b.selectExpr("item_id AS case_id", "concat('r', item_id % 3) AS region", "split(text, '[.] ') AS title_terms", "IF(item_id % 7 = 0, 'UNAVAILABLE_X', 'PUBLIC') AS availability", "IF(item_id % 11 = 0, item_id, NULL) AS project_id", "CAST(NULL AS STRING) AS source_url", "IF(item_id % 5 = 0, concat('art', item_id), NULL) AS source_artifact")
    rows = load(spark, sf, "documents").selectExpr("doc_id AS project_id", "CAST(NULL AS STRING) AS source_url", "text")
    artifacts = b.where("item_id % 5 = 0").selectExpr("concat('art', item_id) AS name", "text")
    return metrics.recall_cases(cases, rows, artifacts)


@query(f"WITH {_CASES} SELECT item_id AS case_id, status, how AS matched_by, doc_id AS matched_project_id FROM states")
def recall_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _recalled(spark, sf).select("case_id", "status", "matched_by", "matched_project_id")


@query(f"WITH {_CASES} SELECT region, count(*) AS total, count_if(status = 'MATCHED')::BIGINT AS matched, count_if(NOT absent)::BIGINT AS observable, count_if(status = 'UNAVAILABLE_IN_LOCAL_CORPUS')::BIGINT AS unavailable, round(count_if(status = 'MATCHED' AND NOT absent) / nullif(count_if(NOT absent), 0), 4) AS observable_recall FROM states GROUP BY 1")
def recall_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.recall_by_region(_recalled(spark, sf))


@query("SELECT item_id, doc_id FROM (SELECT item_id, min(doc_id) AS doc_id FROM benchmark LEFT JOIN documents d ON contains(d.text, benchmark.text) GROUP BY 1)")
def recall_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The first document that holds each case whole."""
    cases = load(spark, sf, "benchmark").select("item_id", F.array("text").alias("terms"))
    hits = metrics.least_containing(cases, load(spark, sf, "documents").select("doc_id", "text"), "item_id", "terms", "doc_id", "text")
    return cases.select("item_id").join(hits.groupBy("item_id").agg(F.min("doc_id").alias("doc_id")), "item_id", "left")


def _sample_sql(n: int) -> str:
    """Each required tag takes the first row that none before took; then the first of the others."""
    tags = {"OPEN": "k % 7 = 3", "UNKNOWN": "k % 7 <> 3", "PDF": "k % 17 = 0", "CHANGE": "k % 5 = 0", "MULTI_SOURCE": "k % 17 = 0", "SECONDARY_SOURCE": "p LIKE '5-%'"}
    parts, taken = ["o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders)"], []
    for i, tag in enumerate(metrics.SAMPLE_TAGS):
        if tag in tags:
            parts.append(f"t{i} AS (SELECT min(k) AS k, {i} AS ord FROM o WHERE {tags[tag]}" + "".join(f" AND k NOT IN (SELECT k FROM t{j})" for j in taken) + ")")
            taken.append(i)
    first = " UNION ALL ".join(f"SELECT k, ord FROM t{i}" for i in taken)
    return f"WITH {', '.join(parts)}, f AS ({first}) SELECT o.k AS project_id FROM o LEFT JOIN f USING (k) ORDER BY ord NULLS LAST, o.k LIMIT {n}"


@query(_sample_sql(40))
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    k = "o_orderkey"
    tags = f"filter(array(IF({k} % 7 = 3, 'OPEN', 'UNKNOWN'), IF({k} % 17 = 0, 'PDF', ''), IF({k} % 5 = 0, 'CHANGE', ''), IF({k} % 17 = 0, 'MULTI_SOURCE', ''), IF(o_orderpriority LIKE '5-%', 'SECONDARY_SOURCE', '')), x -> x <> '')"
    rows = load(spark, sf, "orders").selectExpr(f"{k} AS project_id", f"{tags} AS tags")
    return metrics.review_sample(rows, "project_id", "tags", 40).select("project_id")


@query("SELECT round(sum(l_linenumber) / sum(l_linenumber + 2), 4) AS rule_success_rate, round(sum(l_linenumber) / sum(l_quantity), 4) AS evidence_coverage_rate, round(count_if(l_returnflag = 'R') / count(*), 4) AS review_rate FROM lineitem")
def summary_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_linenumber AS fields_found", "l_linenumber + 2 AS fields_expected", "l_linenumber AS evidence_covered", "l_quantity AS evidence_total", "IF(l_returnflag = 'R', 1, 0) AS review_items", "1 AS processed")
    return metrics.summary_rates(rows)


@query("SELECT 'province' AS level, count(*) AS n FROM region UNION ALL SELECT 'city', count(*) FROM nation")
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "region").selectExpr("'province' AS level").unionByName(load(spark, sf, "nation").selectExpr("IF(n_nationkey % 2 = 0, 'city', 'prefecture') AS level"))
    return metrics.region_counts(rows)


_LCS = """norm AS (SELECT DISTINCT lower(regexp_replace(p_name, '[\\s\\-_.,:;/()\\[\\]]+', '', 'g')) AS n FROM part),
dp(a, b, i, r) AS (
  SELECT x.n, y.n, 0, list_transform(range(length(y.n) + 1), lambda k: 0) FROM norm x JOIN norm y ON x.n < y.n
  UNION ALL SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN r[k] + 1 ELSE 0 END))))) FROM dp WHERE i < length(a)),
ratios AS (SELECT a, b, 200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)) AS ratio FROM dp WHERE i = length(a))"""


@query(f"WITH RECURSIVE {_LCS} SELECT a, b, ratio FROM ratios WHERE ratio >= 70")
def fuzzy_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.core import fuzzy_pairs

    return fuzzy_pairs(load(spark, sf, "part"), "p_name", threshold=70.0)


_PARTS = """p AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '')) AS n, CASE WHEN p_partkey % 400 = 7 THEN 'T' || p_size % 5 END AS tc, CASE WHEN p_partkey % 300 = 5 THEN 'P' || p_size % 4 END AS pc, p_size % 10 AS cap, lower(replace(p_brand, '#', '#')) AS party FROM part WHERE p_partkey % 10 = 7 OR p_partkey % 300 = 5)"""


@query(f"""WITH RECURSIVE {_LCS}, {_PARTS},
  cls AS (SELECT n, party, cap, min(id) AS id FROM p GROUP BY 1, 2, 3),
  r AS (SELECT a, b, ratio FROM ratios WHERE ratio >= 85 UNION ALL SELECT b, a, ratio FROM ratios WHERE ratio >= 85 UNION ALL SELECT n, n, 100.0::DOUBLE FROM norm),
  probable AS (SELECT x.id AS l, y.id AS r, ratio AS score FROM cls x JOIN r ON a = x.n JOIN cls y ON b = y.n WHERE x.id <> y.id AND (x.party = y.party OR abs(x.cap - y.cap) <= greatest(0.1::DOUBLE, greatest(x.cap, y.cap) * 0.01::DOUBLE))),
  codes AS (SELECT id, 'T' AS kind, tc AS code, 100.0::DOUBLE AS score FROM p WHERE tc IS NOT NULL UNION ALL SELECT id, 'P', pc, 99.0::DOUBLE FROM p WHERE pc IS NOT NULL),
  exact AS (SELECT x.id AS l, min(y.id) AS r, any_value(x.score) AS score FROM codes x JOIN codes y ON x.kind = y.kind AND x.code = y.code AND x.id <> y.id GROUP BY x.id, x.kind),
  found AS (SELECT l, r, 1 AS e, score FROM exact UNION ALL SELECT l, r, 0, score FROM probable),
  best AS (SELECT l, r, max(e) AS e, max_by(score, (e, score)) AS score FROM found GROUP BY 1, 2)
  SELECT l AS left_id, r AS right_id, CASE WHEN e = 1 THEN 'EXACT' ELSE 'PROBABLE' END AS outcome, score FROM best""")
def record_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").where("p_partkey % 10 = 7 OR p_partkey % 300 = 5").selectExpr(
        "p_partkey AS project_id", "p_name AS project_name", "IF(p_partkey % 400 = 7, concat('T', p_size % 5), NULL) AS tender_code", "IF(p_partkey % 300 = 5, concat('P', p_size % 4), '') AS project_code", "'' AS owner", "p_brand AS purchaser",
        "CAST(NULL AS STRING) AS province", "CAST(NULL AS STRING) AS city", "'' AS county", "CAST(p_size % 10 AS DOUBLE) AS capacity_mw", "CAST(NULL AS TIMESTAMP_NTZ) AS publish_time",
    )
    return matching.match_records(rows, rows).select("left_id", "right_id", "outcome", "score")


@query("SELECT l_orderkey AS left_id, min_by(l_partkey, (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, -l_linenumber, l_partkey)) AS right_id FROM lineitem GROUP BY 1")
def best_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS left_id", "l_partkey AS right_id", "IF(l_returnflag = 'R', 'EXACT', 'PROBABLE') AS outcome", "CAST(l_linenumber AS DOUBLE) AS score")
    return matching.best_match(rows).select("left_id", "right_id")


@query("SELECT c_custkey, n_name AS city, r_name AS province FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND contains(replace(lower(n_name), '_', ''), 'nation2')")
def region_match(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    return rows.where(recall.region_condition(rows, recall.Criteria(low="", high="", province="ASIA", city="Nation-2")))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') AND contains(lower(lang), 'en') AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1')) ORDER BY doc_id LIMIT 50")
def fulltext_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), F.col("text").alias("qualification_summary"), F.col("source").alias("owner"), F.col("lang").alias("agency"))
    found = recall.find_projects(rows.where("lower(agency) LIKE '%en%'"), " SRC1  Thing ", 50)
    return found.select(F.col("project_id").alias("doc_id"))


@query("SELECT o_orderkey AS project_id, coalesce((SELECT string_agg('line ' || l_linestatus, ' ' ORDER BY l_shipdate, l_linenumber, l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS announced_text FROM orders")
def project_texts(spark: SparkSession, sf: str) -> DataFrame:
    return recall.with_texts(load(spark, sf, "orders").selectExpr("o_orderkey AS project_id"), notes(spark, sf))


@query("SELECT o_orderkey AS project_id, o_orderpriority AS value, CASE WHEN manual <> 'N' THEN manual ELSE o_orderpriority END AS effective FROM (SELECT o_orderkey, o_orderpriority, (SELECT max_by(l_returnflag, (l_shipdate, l_returnflag = 'R', l_returnflag = 'A')) FROM lineitem WHERE l_orderkey = o_orderkey) AS manual FROM orders)")
def override_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as overrides of a priority, in the order of their dates; flag N clears."""
    from tidemark.operators.merge import effective_values

    automatic = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", "'priority' AS field_name", "o_orderpriority AS value")
    events = load(spark, sf, "lineitem").selectExpr("l_orderkey AS project_id", "'priority' AS field_name", "l_shipdate AS changed_at", "IF(l_returnflag = 'N', NULL, l_returnflag) AS manual_value")
    return effective_values(automatic, events, ["project_id", "field_name"]).select("project_id", "value", "effective")


_UPSERT = """new AS (SELECT o_orderkey AS p, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 7 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS s FROM orders WHERE o_orderkey % 3 <> 0),
old AS (SELECT o_orderkey AS p, o_orderpriority AS a, CASE WHEN o_orderkey % 14 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS s FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0)"""


@query(f"""WITH {_UPSERT} SELECT coalesce(old.p, new.p) AS project_id, CASE WHEN new.p IS NULL OR (old.p IS NOT NULL AND old.p % 4 = 0) THEN old.a ELSE new.a END AS owner, coalesce(new.s, old.s) AS status,
  CASE WHEN new.p IS NULL THEN 'UNCHANGED' WHEN old.p IS NULL THEN 'NEW' WHEN old.s = 'CLOSED' AND new.s = 'OPEN' THEN 'REOPENED' WHEN old.s <> new.s OR (old.p % 4 <> 0 AND new.a IS DISTINCT FROM old.a) THEN 'UPDATED' ELSE 'UNCHANGED' END AS lifecycle_state FROM old FULL JOIN new ON old.p = new.p""")
def project_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf)[0].select("project_id", "owner", "status", "lifecycle_state")


@query(f"WITH {_UPSERT} SELECT old.p AS project_id, 'owner' AS field_name, old.a AS old_value, new.a AS new_value FROM old JOIN new ON old.p = new.p WHERE old.p % 4 <> 0 AND old.a IS DISTINCT FROM new.a")
def upsert_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf)[2].select("project_id", "field_name", "old_value", "new_value")


def _upserted(spark: SparkSession, sf: str):
    from tidemark.operators.merge import upsert_projects

    o = load(spark, sf, "orders")
    new = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS project_id", "IF(o_orderkey % 10 = 0, NULL, o_orderpriority) AS owner", "IF(o_orderkey % 7 = 0, 'OPEN', 'CLOSED') AS status")
    old = o.where("o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0").selectExpr("o_orderkey AS project_id", "o_orderpriority AS owner", "IF(o_orderkey % 14 = 0, 'OPEN', 'CLOSED') AS status", "'UNCHANGED' AS lifecycle_state", "o_orderdate AS last_change_at")
    overrides = o.where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS project_id", "'owner' AS field_name", "'x' AS automatic_value", "true AS active")
    return upsert_projects(old, new, overrides, "project_id", ["owner"], now())
