"""Queries over notices written from ``orders`` and ``customer``: their fields follow from keys, so SQL states them without reading text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import extract as X
from tidemark.functions import leads as L
from tidemark.operators import enrich, merge, notices
from tidemark.operators.core import code_groups, recalculate_status
from tidemark.operators.places import Places
from tidemark.plans.bindings import NOW, PROJECTS, evidence, load, projects, spread
from tidemark.plans.catalog import now, query

PROVINCES = (("陕西省", "西安市"), ("甘肃省", "兰州市"), ("青海省", "西宁市"), ("新疆维吾尔自治区", "哈密市"), ("宁夏回族自治区", "银川市"))
WORKS = ("EPC总承包", "支架类采购", "可研编制", "竣工验收", "设备采购", "设备钢平台")
KINDS = ("招标公告", "延期公告", "中标候选人公示", "澄清公告", "询比公告")
PLACES = Places(
    [{"code": f"p{i}", "name": p, "aliases": (p[:2],), "level": "province"} for i, (p, _) in enumerate(PROVINCES)]
    + [{"code": f"c{i}", "name": c, "aliases": (c[:2],), "level": "city", "parent": f"p{i}"} for i, (_, c) in enumerate(PROVINCES)]
)


def _pick(words, of: str) -> str:
    return f"element_at(array({', '.join(repr(w) for w in words)}), cast({of} as int) + 1)"


def written_notices(spark: SparkSession, sf: str) -> DataFrame:
    """project_id, url, title, text. Every third lacks a code, every fourth a tenderer, every fifth a registration window."""
    k = "o_orderkey"
    day = lambda n: f"date_format(o_orderdate + make_dt_interval(cast({n} as int)), 'yyyy年M月d日')"
    name = f"concat({_pick([c[:2] for _, c in PROVINCES], f'{k} % 5')}, 'L', {k}, '号光伏', {_pick(WORKS, f'{k} % 6')}, '项目')"
    text = f"""concat('项目名称：', {name}, '。',
      if({k} % 3 = 0, '', concat('项目编号：T-', {k}, '。')), if({k} % 4 = 0, '', concat('招标人：第', o_custkey, '能源有限公司。')), '招标代理机构：代理', o_custkey % 7, '公司。',
      '预算金额：', {k} % 90 + 10, '万元。', '装机', {k} % 200 + 1, 'MW。',
      if({k} % 5 = 0, '', concat('报名时间：', {day('0')}, '09:00至', {day(f'{k} % 40')}, '17:00。')),
      '投标截止时间：', {day(f'30 + {k} % 90')}, '17:30。开标时间：', {day(f'31 + {k} % 90')}, '上午9点。建设地点：', {_pick([c for _, c in PROVINCES], f'{k} % 5')}, '。')"""
    orders = spread(load(spark, sf, "orders").select(k, "o_custkey", "o_orderdate"))
    return orders.selectExpr(f"{k} AS project_id", "o_custkey", f"concat('https://example.com/n/', {k}) AS url", f"concat({name}, {_pick(KINDS, f'{k} % 5')}) AS title", f"{text} AS text")


_CITY = "(['西安','兰州','西宁','哈密','银川'])[o_orderkey % 5 + 1]"
_NAME = f"{_CITY} || 'L' || o_orderkey || '号光伏' || (['EPC总承包','支架类采购','可研编制','竣工验收','设备采购','设备钢平台'])[o_orderkey % 6 + 1] || '项目'"
_LEAD = "(['PROJECT_LEVEL_EPC', NULL, 'EARLY_STAGE_TRACKING', 'COMPLETED_INSTALLATION_SIGNAL', NULL, 'ADJACENT_STRUCTURE'])[o_orderkey % 6 + 1]"
_DAY = "date_trunc('day', o_orderdate)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return notices.extract_notices(written_notices(spark, sf).withColumnRenamed("project_id", "order_id"), 1998, now())


@query(f"""SELECT o_orderkey AS order_id, {_NAME} AS project_name, CASE WHEN o_orderkey % 4 <> 0 THEN '第' || o_custkey || '能源有限公司' END AS owner, '代理' || o_custkey % 7 || '公司' AS agency,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'T-' || o_orderkey END AS project_code, ((o_orderkey % 90 + 10) * 10000)::BIGINT AS budget, (o_orderkey % 200 + 1)::DOUBLE AS capacity_mw,
  CASE WHEN o_orderkey % 5 <> 0 THEN {_DAY} + INTERVAL 9 HOUR END AS registration_start, CASE WHEN o_orderkey % 5 <> 0 THEN {_DAY} + to_days((o_orderkey % 40)::INT) + INTERVAL 17 HOUR END AS registration_deadline,
  {_DAY} + to_days((30 + o_orderkey % 90)::INT) + INTERVAL '17 hours 30 minutes' AS bid_deadline, {_DAY} + to_days((31 + o_orderkey % 90)::INT) + INTERVAL 9 HOUR AS open_time,
  (['招标公告','延期公告','中标候选人公示','澄清公告','询比公告'])[o_orderkey % 5 + 1] AS announcement_type FROM orders""")
def notice_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("order_id", "project_name", "owner", "agency", "project_code", F.col("budget").cast("long").alias("budget"), "capacity_mw", "registration_start", "registration_deadline", "bid_deadline", "open_time", "announcement_type")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 <> 0 THEN '报名时间：' || strftime(o_orderdate, '%Y年%-m月%-d日') || '09:00至' || strftime(o_orderdate + to_days((o_orderkey % 40)::INT), '%Y年%-m月%-d日') || '17:00。' END AS registration_raw,
  array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'owner' END, CASE WHEN o_orderkey % 3 = 0 THEN 'project_code' END, CASE WHEN o_orderkey % 5 = 0 THEN 'registration_deadline' END, 'document_deadline'], lambda x: x IS NOT NULL), ',') AS missing FROM orders""")
def notice_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("order_id", "registration_raw", F.array_join("missing", ",").alias("missing"))


@query("""SELECT field_name, sum(n)::BIGINT AS n FROM (SELECT 'project_name' AS field_name, count(*) AS n FROM orders UNION ALL SELECT 'owner', count_if(o_orderkey % 4 <> 0) FROM orders UNION ALL SELECT 'agency', count(*) FROM orders
  UNION ALL SELECT 'project_code', count_if(o_orderkey % 3 <> 0) FROM orders UNION ALL SELECT 'project_type', count_if(o_orderkey % 6 IN (0, 4)) FROM orders UNION ALL SELECT 'budget', count(*) FROM orders
  UNION ALL SELECT unnest(['registration_start', 'registration_deadline']), (SELECT count_if(o_orderkey % 5 <> 0) FROM orders) UNION ALL SELECT unnest(['bid_deadline', 'open_time', 'capacity_mw']), (SELECT count(*) FROM orders)) GROUP BY 1 HAVING sum(n) > 0""")
def notice_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return notices.evidence_of(_records(spark, sf)).groupBy("field_name").agg(F.count("*").alias("n"))


@query(f"""SELECT o_orderkey AS project_id, {_NAME} AS name, CASE WHEN o_orderkey % 3 <> 0 THEN 'T-' || o_orderkey END AS project_code,
  CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0 THEN 'RESOLVED' ELSE 'PARTIAL' END AS identity_status, CASE WHEN o_orderkey % 3 <> 0 THEN 100 WHEN o_orderkey % 4 <> 0 THEN 85 ELSE 65 END::INT AS confidence FROM orders""")
def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = written_notices(spark, sf).withColumn("i", X.identity(F.col("title"), F.col("text")))
    return rows.select("project_id", F.col("i.canonical_name").alias("name"), "i.project_code", "i.identity_status", F.round(F.col("i.confidence") * 100).cast("int").alias("confidence"))


@query(f"SELECT o_orderkey AS project_id, {_CITY} || '市' AS city, (['陕西省','甘肃省','青海省','新疆维吾尔自治区','宁夏回族自治区'])[o_orderkey % 5 + 1] AS province FROM orders")
def place_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = written_notices(spark, sf).withColumn("place", PLACES.match(X.location_hint(F.col("title"), F.col("text"))))
    return rows.select("project_id", F.element_at("place.path", 2).alias("city"), F.element_at("place.path", 1).alias("province"))


@query(f"""SELECT o_orderkey AS project_id, {_LEAD} AS lead, CASE o_orderkey % 6 WHEN 0 THEN '支架 设备材料' WHEN 2 THEN '光伏支架 采购' WHEN 3 THEN '支架 采购' ELSE '光伏支架' END AS first_query FROM orders WHERE {_LEAD} IS NOT NULL""")
def lead_classes(spark: SparkSession, sf: str) -> DataFrame:
    # a generator, so that the class isn't worked out again by the filter
    lead = F.explode(F.array_compact(F.array(L.lead_type(F.concat_ws(" ", "title", "text")))))
    rows = written_notices(spark, sf).select("project_id", "title", lead.alias("lead"))
    return rows.select("project_id", "lead", F.regexp_extract(F.get(L.follow_ups(L.lead_identity(F.col("title")), F.col("lead")), F.lit(0)), '" (.*)$', 1).alias("first_query"))


_REVIEW = """WITH {projects}, r AS (SELECT *, split_part(reason_code, '_', 1) AS status, CASE WHEN o_orderpriority LIKE '5-%' THEN 'E' ELSE 'A' END AS source_level FROM reasons)"""


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    status = recalculate_status(projects(spark, sf), evidence(spark, sf), now())
    level = F.when(F.startswith("o_orderpriority", F.lit("5-")), "E").otherwise("A")
    return projects(spark, sf).join(status, "project_id").withColumns({"source_level": level, **{f: F.lit(False) for f in ("identity_conflict", "field_conflict", "parse_failed", "low_quality_pdf", "unproven")}})


_RULES = _REVIEW.format(projects=PROJECTS) + f""", rules AS (SELECT project_id, publish_time, o_totalprice, status, list_filter([
    CASE WHEN reason_code = 'UNKNOWN_CONFLICTING_DATES' THEN 'CONFLICTING_DATE' END,
    CASE WHEN status = 'UNKNOWN' AND coalesce(qd, rd, dd) IS NULL THEN 'SOURCE_INCOMPLETE' END,
    CASE WHEN status = 'UNKNOWN' AND bid IS NOT NULL AND coalesce(rd, dd) IS NULL THEN 'UNKNOWN_PARTICIPATION_RULE' END,
    CASE WHEN source_level = 'E' THEN 'ONLY_SECONDARY_SOURCE' END,
    CASE WHEN status = 'OPEN' AND coalesce(rd, dd) IS NULL THEN 'OPEN_PARTICIPATION_UNCLEAR' END,
    CASE WHEN len(list_filter([qd, rd, dd, bid, opened], lambda d: d >= TIMESTAMP '{NOW}' AND d <= TIMESTAMP '{NOW}' + INTERVAL 3 DAY)) > 0 THEN 'DEADLINE_WITHIN_3_DAYS' END], lambda x: x IS NOT NULL) AS reasons FROM r)"""
_PRIORITY = "CASE WHEN list_has_any(reasons, ['CONFLICTING_DATE', 'DEADLINE_WITHIN_3_DAYS']) THEN 1 WHEN o_totalprice * 100 >= 10000000 THEN 2 WHEN status = 'UNKNOWN' THEN 3 WHEN list_contains(reasons, 'ONLY_SECONDARY_SOURCE') THEN 4 ELSE 5 END::INT"


@query(_RULES + f" SELECT project_id, array_to_string(reasons, ',') AS reasons, {_PRIORITY} AS priority FROM rules")
def review_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reviewed(spark, sf).withColumn("reasons", L.review_reasons(now()))
    priority = L.review_priority(F.col("reasons"), F.lit(None).cast("double"), F.col("o_totalprice") * 100, F.col("status"))
    return rows.select("project_id", F.array_join("reasons", ",").alias("reasons"), priority.alias("priority"))


@query(_RULES + f" SELECT project_id, reasons[1] AS reason, {_PRIORITY} AS priority FROM rules WHERE len(reasons) > 0 ORDER BY {_PRIORITY}, publish_time, project_id LIMIT 200")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 projects with reasons, by priority and time."""
    rows = _reviewed(spark, sf).withColumn("reasons", L.review_reasons(now())).where(F.size("reasons") > 0)
    rows = rows.withColumn("priority", L.review_priority(F.col("reasons"), F.lit(None).cast("double"), F.col("o_totalprice") * 100, F.col("status")))
    return rows.orderBy("priority", "publish_time", "project_id").limit(200).select("project_id", F.get("reasons", F.lit(0)).alias("reason"), "priority")


@query(_REVIEW.format(projects=PROJECTS) + """ SELECT project_id, array_to_string(list_filter([CASE WHEN status = 'UNKNOWN' THEN 'UNKNOWN_STATUS' END, CASE WHEN source_level = 'E' THEN 'LOW_SOURCE_LEVEL' END,
  CASE WHEN coalesce(rd, dd, bid) IS NULL THEN 'MISSING_DEADLINE' END, CASE WHEN rd IS NULL THEN 'REGISTRATION_UNCLEAR' END, CASE WHEN reason_code = 'UNKNOWN_CONFLICTING_DATES' THEN 'CONFLICTING_DATES' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def verification_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf).select("project_id", F.array_join(L.verification_reasons(), ",").alias("reasons"))


@query("""SELECT c_custkey, unnest(list_distinct([c_name, c_mktsegment, '"' || c_name || '" 招标', '"' || c_name || '" 延期', '"' || c_name || '" 变更', '"' || c_name || '" 澄清', '"' || c_mktsegment || '" "' || c_name || '"'])) AS query_text FROM customer""")
def verification_queries(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    made = L.verification_queries(F.col("c_name"), none, none, F.col("c_mktsegment"), none)
    return load(spark, sf, "customer").select("c_custkey", F.explode(made).alias("query_text"))


@query("""SELECT c_custkey, unnest(['"' || c_name || '"', '"' || c_name || '" "' || c_mktsegment || '"', '"' || c_mktsegment || '" ' || c_name, 'site:' || c_mktsegment || ' "' || c_name || '"', '"' || c_name || '" 变更', '"' || c_name || '" 澄清', '"' || c_name || '" 延期', '"' || c_name || '" 中标候选人', '"' || c_name || '" 中标结果', '"' || c_name || '" 流标', '"' || c_name || '" 重新招标']) AS query_text FROM customer""")
def enrichment_queries(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    made = L.enrichment_queries(F.col("c_name"), none, none, F.col("c_mktsegment"), none)
    return load(spark, sf, "customer").select("c_custkey", F.explode(made).alias("q")).select("c_custkey", "q.query_text")


@query("""WITH o AS (SELECT l_orderkey AS k, max_by(l_returnflag, (l_linenumber, l_returnflag)) AS flag, max(l_linenumber) AS n, max(l_shipdate) AS t FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
  n AS (SELECT l_orderkey AS k, max_by(l_returnflag, (l_linenumber, l_returnflag)) AS flag, max(l_linenumber) AS n, max(l_shipdate) AS t FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
  SELECT coalesce(o.k, n.k) AS candidate_key, CASE WHEN o.flag = 'A' OR n.flag = 'A' THEN 'A' WHEN o.flag = 'N' OR n.flag = 'N' THEN 'B' ELSE 'E' END AS source_level, coalesce(o.flag = 'A', false) OR coalesce(n.flag = 'A', false) AS official_found,
    CASE WHEN n.flag IS NULL OR (n.flag = 'R' AND o.flag IS NOT NULL) THEN o.flag ELSE n.flag END AS owner, coalesce(n.n, o.n)::STRING AS scope,
    CASE WHEN o.k IS NULL THEN n.t WHEN n.k IS NULL OR o.flag = n.flag THEN o.t ELSE n.t END AS last_change_at FROM o FULL JOIN n ON o.k = n.k""")
def candidate_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Early line items are known candidates, later ones a batch of results; flag R is an ambiguous identity."""

    def state(where: str) -> DataFrame:
        rows = load(spark, sf, "lineitem").where(where).groupBy(F.col("l_orderkey").alias("candidate_key")).agg(F.max(F.struct("l_linenumber", "l_returnflag")).alias("b"), F.max("l_shipdate").alias("seen"))
        flag = F.col("b.l_returnflag")
        return rows.select(
            "candidate_key", F.create_map(F.lit("owner"), flag, F.lit("scope"), F.col("b.l_linenumber").cast("string")).alias("candidate_values"), F.when(flag == "A", "A").when(flag == "N", "B").otherwise("E").alias("source_level"),
            F.lit("POSSIBLE").alias("relevance_class"), F.when(flag == "R", "AMBIGUOUS").otherwise("RESOLVED").alias("identity_status"), F.lit(1.0).alias("identity_confidence"), (flag == "A").alias("official_found"), flag.alias("content_hash"),
            F.lit("PARTIAL").alias("enrichment_state"), F.col("seen").alias("first_seen_at"), F.col("seen").alias("last_seen_at"), F.col("seen").alias("last_change_at"),
        )

    merged = merge.upsert_candidates(state("l_linenumber <= 2"), state("l_linenumber > 2"))
    return merged.select("candidate_key", "source_level", "official_found", F.col("candidate_values.owner").alias("owner"), F.col("candidate_values.scope").alias("scope"), "last_change_at")


@query(r"""WITH m AS (SELECT *, min(p_partkey) OVER (PARTITION BY lower(replace(replace(p_brand || p_type, ' ', ''), '#', '#'))) AS c FROM part)
  SELECT c AS p_partkey, coalesce(max(CASE WHEN p_partkey = c AND p_size % 3 <> 0 THEN p_size END), min_by(p_size, (p_retailprice, p_partkey)) FILTER (p_partkey <> c AND p_size % 3 <> 0)) AS p_size, count(*) AS n_merged FROM m GROUP BY 1""")
def project_merge(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").withColumn("p_size", F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    members = code_groups(part, "p_partkey", F.concat("p_brand", "p_type"))
    return merge.merge_projects(part.select("p_partkey", "p_size", "p_retailprice"), members, "p_partkey", ["p_retailprice"]).select("p_partkey", "p_size", "n_merged")


@query("""SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 2 = 0 THEN 'P' || c_custkey END AS project_code, CASE WHEN c_custkey % 2 = 0 THEN 'W' || c_nationkey END AS agency,
  (8 + CASE WHEN c_custkey % 2 = 0 THEN 3 + 3 ELSE 0 END)::BIGINT AS n_asked, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END::INT AS last_round FROM customer""")
def enrichment_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """A name's result gives even customers a code, the code's result an agency; each fact leads to further queries."""
    none = F.lit(None).cast("string")
    c = load(spark, sf, "customer")
    code = F.concat(F.lit("P"), "c_custkey")
    candidates = c.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"), none.alias("project_code"), none.alias("tender_code"), none.alias("tenderer"), none.alias("agency"))
    page = lambda q, code, agency: F.struct(q.alias("query_text"), F.concat(F.lit("u"), q).alias("url"), none.alias("name"), code.alias("project_code"), none.alias("tender_code"), none.alias("tenderer"), agency.alias("agency"))
    index = c.where("c_custkey % 2 = 0").select(F.explode(F.array(page(L.quoted(F.col("c_name")), code, none), page(L.quoted(code), none, F.concat(F.lit("W"), "c_nationkey")))).alias("p")).select("p.*")
    known, asked = enrich.enrichment_rounds(candidates, index)
    counts = asked.groupBy("candidate_id").agg(F.count("*").alias("n_asked"), F.max("round").alias("last_round"))
    return known.join(counts, "candidate_id").select("candidate_id", "project_code", "agency", "n_asked", "last_round")


@query("""SELECT s_suppkey AS lead_id, CASE WHEN s_suppkey % 5 = 0 THEN 'NO_IDENTITY' WHEN s_suppkey % 5 = 1 THEN 'FOUND_OFFICIAL' WHEN s_suppkey % 5 = 2 THEN 'BLOCKED' ELSE 'NOT_FOUND' END AS status, CASE WHEN s_suppkey % 5 = 1 THEN 'https://gov.example/' || s_suppkey END AS official_url FROM supplier""")
def official_trace(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    s = load(spark, sf, "supplier")
    leads = s.select(k.alias("lead_id"), F.when(k % 5 != 0, name).alias("name"), F.array().cast("array<string>").alias("codes"), F.lit("").alias("owner"))
    index = s.where("s_suppkey % 5 <> 4").select(F.concat(L.quoted(name), F.lit(" 采购公告")).alias("query_text"), F.lit(1).alias("place"), F.concat(F.lit("https://gov.example/"), k).alias("url"), F.when(k % 5 == 3, "other").otherwise(name).alias("text"), F.lit(True).alias("is_official"), (k % 5 == 2).alias("blocked"))
    return enrich.trace_official(leads, index)


@query("SELECT o_orderkey AS project_id, field, CASE WHEN field = 'a' THEN o_orderpriority ELSE o_orderstatus END AS old_value, x AS new_value FROM (SELECT *, unnest(['a', 'b']) AS field FROM orders), LATERAL (SELECT CASE WHEN field = 'a' THEN CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END END AS x) WHERE x IS DISTINCT FROM CASE WHEN field = 'a' THEN o_orderpriority ELSE o_orderstatus END")
def project_changes(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", "o_orderpriority AS a", "o_orderstatus AS b")
    new = old.withColumns({"a": F.when(F.col("project_id") % 10 != 0, F.col("a")), "b": F.when(F.col("project_id") % 7 == 0, "Z").otherwise(F.col("b"))})
    return merge.project_changes(old, new, "project_id", ["a", "b"]).withColumnRenamed("field_name", "field")


@query("SELECT l_orderkey AS candidate_id, l_returnflag AS canonical_url, bool_or(l_linestatus = 'F') AS is_official, bool_or(l_linestatus <> 'F') AS is_secondary, min(CASE WHEN l_quantity < 25 THEN 'A' ELSE 'D' END) AS source_level, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at FROM lineitem GROUP BY 1, 2")
def source_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS candidate_id", "l_returnflag AS canonical_url", "l_linestatus = 'F' AS is_official", "l_linestatus <> 'F' AS is_secondary", "IF(l_quantity < 25, 'A', 'D') AS source_level", "l_shipdate AS seen_at")
    return merge.linked_sources(rows)


@query("SELECT s_suppkey::STRING AS source_id, CASE WHEN s_suppkey % 11 = 0 THEN 'DISABLED' WHEN s_suppkey % 7 = 0 THEN 'MANUAL_ACTION_REQUIRED' WHEN s_suppkey % 5 = 0 THEN 'CATALOG_ONLY' WHEN s_suppkey % 3 = 0 THEN 'ADAPTER_NOT_CONFIGURED' ELSE 'READY' END AS reason FROM supplier WHERE s_acctbal > 0")
def source_plan(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS source_id", "s_nationkey AS priority", "s_acctbal", "s_suppkey % 11 <> 0 AS enabled", "s_suppkey % 3 <> 0 AS crawl_enabled", "'site' AS adapter", "IF(s_suppkey % 5 = 0, 'CATALOG', 'SITE') AS adapter_level", "'http' AS access_method", "IF(s_suppkey % 7 = 0, 'LOGIN', NULL) AS manual_action"
    )
    return notices.source_plan(s, F.col("s_acctbal") > 0).select("source_id", "reason")
