"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.operators import core
from tidemark.plans.bindings import NOW, PROJECTS, announcements, evidence, load, projects

FLAGSHIP = "status_recalc"
QUERIES: dict = {}
SQL: dict[str, str] = {}
TERMS = ("the", "and", "que", "der", "trash")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {PROJECTS} SELECT project_id, split_part(reason_code, '_', 1) AS status, reason_code FROM reasons")
def status_recalc(spark: SparkSession, sf: str) -> DataFrame:
    return core.recalculate_status(projects(spark, sf), evidence(spark, sf), now())


@query(f"WITH {PROJECTS} SELECT project_id, array_to_string(missing, ',') AS missing, array_to_string(weak, ',') AS weak FROM gated")
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = core.with_gate(projects(spark, sf), evidence(spark, sf))
    return gated.select("project_id", F.array_join("missing", ",").alias("missing"), F.array_join("weak", ",").alias("weak"))


@query(f"WITH {PROJECTS} SELECT split_part(reason_code, '_', 1) AS status, count(*) AS n FROM reasons GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status_recalc(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT project_id, published_at, id, kind FROM (SELECT l_orderkey AS project_id, l_shipdate AS published_at, l_linenumber AS id, l_returnflag AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber DESC, l_returnflag DESC) AS r FROM lineitem) WHERE r = 1")
def latest_announcement(spark: SparkSession, sf: str) -> DataFrame:
    return core.latest_per_key(announcements(spark, sf), ["project_id"], ["published_at", "id"], ["published_at", "id", "kind"])


@query("SELECT o_orderkey AS project_id FROM orders o WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31')")
def date_window_recall(spark: SparkSession, sf: str) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01 00:00:00", "1997-03-31 00:00:00"))
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", "o_orderdate AS publish_time")
    return core.in_window(rows, announcements(spark, sf), low, high).select("project_id")


@query("WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS code, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), tree(root, code, depth) AS (SELECT code, code, 0 FROM edges WHERE parent IS NULL UNION ALL SELECT t.root, e.code, t.depth + 1 FROM tree t JOIN edges e ON e.parent = t.code) SELECT root, code, depth FROM tree")
def region_closure(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS code", "concat('r', n_regionkey) AS parent")
    region = load(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS code", "CAST(NULL AS STRING) AS parent")
    edges = region.unionByName(nation)
    return spark.sql("WITH RECURSIVE tree(root, code, depth) AS (SELECT code, code, 0 FROM {e} WHERE parent IS NULL UNION ALL SELECT t.root, e.code, t.depth + 1 FROM tree t JOIN {e} e ON e.parent = t.code) SELECT root, code, depth FROM tree", e=edges)


_CANON = r"""
parts AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
canon AS (SELECT page_id, 'https://' || lower(host) || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END ||
  coalesce((SELECT '?' || string_agg(p, '&' ORDER BY p) FROM (SELECT unnest(string_split(query, '&')) AS p) WHERE p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|page)(=|$)')), '') AS canonical_url FROM parts)
"""


@query(f"WITH {_CANON} SELECT page_id, canonical_url FROM canon")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", text.canonicalize_url(F.col("url")).alias("canonical_url"))


@query(f"WITH {_CANON} SELECT canonical_url, min(page_id) AS page_id, count(*) AS n_seen FROM canon GROUP BY 1")
def url_dedupe_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return core.first_seen(url_canonical(spark, sf), ["canonical_url"], "page_id")


@query("SELECT page_id, CASE WHEN regexp_matches(host, '(zhaobiao|bidding|tender)') THEN 'C' WHEN regexp_matches(host, '(news|bjx|solar)') THEN 'D' ELSE 'E' END AS level FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)")
def source_level_filter(spark: SparkSession, sf: str) -> DataFrame:
    leveled = load(spark, sf, "pages").select("page_id", text.source_level(F.col("url")).alias("level"))
    return leveled.where(text.level_rank(F.col("level")) <= 5)


@query("SELECT domain, count(*) AS n_pages, count(*) >= 3 AS recommended FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages) GROUP BY 1")
def domain_rollup_recommend(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "pages").groupBy(text.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n_pages"))
    return n.withColumn("recommended", F.col("n_pages") >= 3)


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS domain, count(DISTINCT page_id) AS n_links, bool_or(starts_with(url, 'https')) AS any_secure, max(page_id) AS last_page FROM pages GROUP BY 1")
def candidate_sources_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").groupBy(text.domain(F.col("url")).alias("domain")).agg(F.count_distinct("page_id").alias("n_links"), F.bool_or(F.startswith("url", F.lit("https"))).alias("any_secure"), F.max("page_id").alias("last_page"))


@query(r"SELECT p_partkey, lower(regexp_replace(p_name, '[\s\-—_()（）【】\[\]，。,.;；:：/\\]+', '', 'g')) AS identity FROM part")
def identity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", text.normalize_identity(F.col("p_name")).alias("identity"))


_FOUND = "(" + " + ".join(f"contains(text, '{t}')::INT" for t in TERMS) + ")"


@query(rf"SELECT doc_id, coalesce(floor(length(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0) * (0.25::DOUBLE + 0.75::DOUBLE * least(1.0::DOUBLE, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) / 400.0::DOUBLE)) * least(1.0::DOUBLE, {_FOUND} / 3.0::DOUBLE) * 10000 + 0.5), 0)::BIGINT AS quality FROM documents")
def doc_quality(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.document_quality(F.col("text"), TERMS).alias("quality"))


@query("SELECT doc_id, array_to_string(list_filter(['the', 'and', 'que', 'der', 'trash'], lambda t: contains(lower(text), t)), ',') AS matched FROM documents WHERE len(list_filter(['the', 'and', 'que', 'der', 'trash'], lambda t: contains(lower(text), t))) > 0")
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    matched = load(spark, sf, "documents").select("doc_id", text.matched_terms(F.col("text"), TERMS).alias("m"))
    return matched.where(F.size("m") > 0).select("doc_id", F.array_join("m", ",").alias("matched"))


@query("SELECT doc_id, CASE WHEN contains(t, 'disgusting') AND contains(t, 'the') THEN 'DIRECT' WHEN contains(t, 'und') AND contains(t, 'nicht') THEN 'EMBEDDED' WHEN contains(t, '|') OR contains(t, '***') THEN 'STRUCTURAL_RELATED' WHEN contains(t, 'und') THEN 'PARENT_PROJECT' WHEN contains(t, 'the') THEN 'POSSIBLE' ELSE 'IRRELEVANT' END AS relevance FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def relevance_class(spark: SparkSession, sf: str) -> DataFrame:
    c = rules.relevance(F.col("text"), direct=["disgusting"], component=["***"], structure=["|"], parent=["und"], contract=["nicht"], procurement=["the"])
    return load(spark, sf, "documents").select("doc_id", c.alias("relevance"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_seen FROM documents GROUP BY 1")
def content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    hashed = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return core.first_seen(hashed, ["content_hash"], "doc_id")


@query(r"SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(regexp_replace(p_brand || p_type, '[\s\-_.,:;/()\[\]]+', '', 'g'))) AS canonical_id FROM part")
def exact_code_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return core.code_groups(load(spark, sf, "part"), "p_partkey", F.concat("p_brand", "p_type"))


@query("SELECT l_orderkey AS project_id, count(DISTINCT l_returnflag) AS n_values, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS found FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2")
def field_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return core.conflicts(announcements(spark, sf), ["project_id"], "kind")


@query("SELECT event_id, user_id, event_type AS new_status, old_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events) WHERE old_status IS DISTINCT FROM event_type")
def status_history(spark: SparkSession, sf: str) -> DataFrame:
    seen = core.previous(load(spark, sf, "events"), "user_id", ["ts", "event_id"], {"old_status": "event_type"})
    return seen.where(~F.col("old_status").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", F.col("event_type").alias("new_status"), "old_status")


@query("SELECT event_id, user_id, CASE WHEN p IS NULL THEN 'NEW' WHEN p = 'error' AND event_type <> 'error' THEN 'REOPENED' WHEN p <> event_type THEN 'UPDATED' ELSE 'UNCHANGED' END AS lifecycle FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    seen = core.previous(load(spark, sf, "events"), "user_id", ["ts", "event_id"], {"p": "event_type"})
    state = rules.first_match([(F.col("p").isNull(), "NEW"), ((F.col("p") == "error") & (F.col("event_type") != "error"), "REOPENED"), (F.col("p") != F.col("event_type"), "UPDATED")], "UNCHANGED")
    return seen.select("event_id", "user_id", state.alias("lifecycle"))


@query("SELECT event_id, user_id, prev AS old_value, value AS new_value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND prev <> value")
def deadline_changes(spark: SparkSession, sf: str) -> DataFrame:
    seen = core.previous(load(spark, sf, "events"), "user_id", ["ts", "event_id"], {"old_value": "value"})
    return seen.where("old_value <> value").select("event_id", "user_id", "old_value", F.col("value").alias("new_value"))


_DAILY = "SELECT event_type AS source_id, ts::DATE AS day, count(*) AS items, count_if(value > 90) AS failures FROM events GROUP BY 1, 2"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("source_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("items"), F.count_if(F.col("value") > 90).alias("failures"))


@query(f"SELECT source_id, day, items, lag(items) OVER (PARTITION BY source_id ORDER BY day) AS previous_items, CASE WHEN failures > 0 THEN 'DEGRADED' ELSE 'ACTIVE' END AS health FROM ({_DAILY})")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    seen = core.previous(_daily(spark, sf), "source_id", ["day"], {"previous_items": "items"})
    return seen.select("source_id", "day", "items", "previous_items", rules.source_health(F.col("items"), F.col("previous_items"), F.col("failures"), F.lit(False)).alias("health"))


@query(f"SELECT source_id, list_reduce(list(items::DOUBLE ORDER BY day), lambda a, b: a * 0.8::DOUBLE + b * 0.2::DOUBLE) AS ema FROM ({_DAILY}) GROUP BY 1")
def source_items_ema(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", "items"))), lambda x: x.items.cast("double"))
    days = _daily(spark, sf).groupBy("source_id").agg(ordered.alias("v"))
    return days.select("source_id", F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), lambda a, x: a * F.lit(0.8) + x * F.lit(0.2)).alias("ema"))


@query("SELECT o_orderkey AS project_id FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS reported_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE reported_at IS NULL OR o_orderdate + INTERVAL 60 DAY > reported_at")
def delta_suppression(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", "o_orderdate + make_dt_interval(60) AS last_change_at")
    reports = announcements(spark, sf).where("kind = 'R'").select("project_id", F.col("published_at").alias("reported_at"))
    return core.unchanged_suppressed(rows, reports, "project_id", F.col("last_change_at") > F.col("reported_at")).select("project_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.source = 'src0' AND s.text = d.text) AND source <> 'src0'")
def lead_suppression(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "source", text.content_hash(F.col("text")).alias("key"))
    return docs.where("source <> 'src0'").join(docs.where("source = 'src0'").select("key"), "key", "left_anti").select("doc_id")


@query(f"WITH {PROJECTS}, l AS (SELECT CASE WHEN project_id % 97 = 0 THEN 'I' WHEN project_id % 89 = 0 THEN 'J' WHEN o_orderstatus = 'P' THEN 'E' WHEN starts_with(reason_code, 'CLOSED') THEN 'H' WHEN project_id % 7 = 0 THEN 'F' WHEN project_id % 5 = 0 THEN 'G' WHEN project_id % 3 = 0 THEN 'D' WHEN starts_with(reason_code, 'OPEN') THEN 'A' ELSE 'B' END AS layer FROM reasons) SELECT layer, count(l.layer) AS n FROM (SELECT unnest(['A','B','C','D','E','F','G','H','I','J']) AS layer) LEFT JOIN l USING (layer) GROUP BY 1")
def result_layers(spark: SparkSession, sf: str) -> DataFrame:
    rows = projects(spark, sf).select("project_id", "o_orderstatus").join(status_recalc(spark, sf), "project_id")
    k = F.col("project_id")
    seen = F.when(k % 7 == 0, "SECONDARY_ONLY").when(k % 5 == 0, "UNVERIFIED").otherwise("VERIFIED")
    layer = rules.result_layer(k % 97 == 0, k % 89 == 0, F.col("o_orderstatus") == "P", F.col("status"), seen, F.when(k % 3 == 0, "ADJACENT").otherwise("DIRECT"), F.lit(True))
    return core.zero_filled_counts(rows.select(layer.alias("layer")), "layer", rules.LAYERS)


@query(f"WITH {PROJECTS} SELECT project_id, reason_code AS reason FROM reasons WHERE starts_with(reason_code, 'UNKNOWN') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = project_id AND l_returnflag = 'A')")
def verification_queue(spark: SparkSession, sf: str) -> DataFrame:
    pending = announcements(spark, sf).where("kind = 'A'").select("project_id")
    return status_recalc(spark, sf).where("status = 'UNKNOWN'").join(pending, "project_id", "left_anti").select("project_id", F.col("reason_code").alias("reason"))


@query("SELECT l_orderkey AS project_id, l_returnflag AS field_name, coalesce(min(CASE WHEN l_linenumber <= 3 THEN l_partkey END), min(CASE WHEN l_linenumber > 3 THEN l_partkey END)) AS page, CASE WHEN min(l_linenumber) <= 3 THEN 0 ELSE 1 END::INT AS inserted FROM lineitem GROUP BY 1, 2")
def evidence_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS project_id", "l_returnflag AS field_name", "l_partkey AS page", "l_linenumber")
    return core.upsert_evidence(rows.where("l_linenumber <= 3").drop("l_linenumber"), rows.where("l_linenumber > 3").drop("l_linenumber"), ["project_id", "field_name"], ["page"])


@query(f"WITH {PROJECTS} SELECT project_id, split_part(reason_code, '_', 1) AS status FROM reasons ORDER BY 2, publish_time DESC, project_id LIMIT 50 OFFSET 100")
def paged_projects(spark: SparkSession, sf: str) -> DataFrame:
    rows = status_recalc(spark, sf).join(projects(spark, sf).select("project_id", "publish_time"), "project_id")
    return rows.orderBy("status", F.desc("publish_time"), "project_id").offset(100).limit(50).select("project_id", "status")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def props_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT l_orderkey AS project_id, min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END)::INT AS best_rank, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS kinds FROM lineitem GROUP BY 1")
def best_per_key_rank(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("kind") == "R", 1).when(F.col("kind") == "A", 2).otherwise(3)
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "kind"))), lambda x: x.kind), "")
    return announcements(spark, sf).groupBy("project_id").agg(F.min(rank).alias("best_rank"), kinds.alias("kinds"))


@query(f"WITH {PROJECTS} SELECT project_id, least(qd, rd, dd, bid, opened) AS next_deadline FROM projects")
def next_deadline(spark: SparkSession, sf: str) -> DataFrame:
    return projects(spark, sf).select("project_id", core.next_deadline().alias("next_deadline"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS tag FROM part) GROUP BY 1")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    tags = load(spark, sf, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))
