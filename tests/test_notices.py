"""Extraction, leads, places, merges, enrichment and requests on small literals."""

from dataclasses import replace
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import extract as X
from tidemark.functions import leads as L
from tidemark.functions import request
from tidemark.operators import enrich, merge, notices
from tidemark.operators.places import Places, region_passes

TEXT = (
    "项目名称：哈密储能EPC项目 招标人：新疆能源有限公司 招标代理机构：西北招标代理有限公司 报名时间：2026年8月27日09:00至2026年9月5日17:00 "
    "文件获取截止时间：2026年9月6日17:00 投标截止时间：2026年9月10日17:00 开标时间：2026年9月10日17:00"
)
NOW = "2026-08-28 12:00:00"
PLACES = Places(
    [
        {"code": "61", "name": "陕西省", "aliases": ("陕西",), "level": "province"},
        {"code": "6101", "name": "西安市", "aliases": ("西安",), "level": "city", "parent": "61"},
        {"code": "610113", "name": "雁塔区", "level": "district", "parent": "6101"},
        {"code": "63", "name": "青海省", "aliases": ("青海",), "level": "province"},
        {"code": "6328", "name": "海西蒙古族藏族自治州", "aliases": ("海西",), "level": "prefecture", "parent": "63"},
    ]
)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_extraction(spark):
    rows = spark.createDataFrame([("https://example.com/notice", "哈密储能EPC项目招标公告", TEXT), ("https://example.com/empty", None, None), ("u", "", "")], "url string, title string, text string")
    out = notices.extract_notices(rows, 2026, now())
    r = {x["url"]: x for x in out.collect()}
    full, empty = r["https://example.com/notice"], r["https://example.com/empty"]
    assert (full["project_name"], full["owner"], full["agency"]) == ("哈密储能EPC项目", "新疆能源有限公司", "西北招标代理有限公司")
    assert (full["registration_start"], full["registration_deadline"]) == (dt(2026, 8, 27, 9), dt(2026, 9, 5, 17))
    assert (full["document_start"], full["document_deadline"]) == (None, dt(2026, 9, 6, 17))
    assert full["bid_deadline"] == full["open_time"] == dt(2026, 9, 10, 17)
    assert (full["reason_code"], full["status"], full["project_type"], full["announcement_type"]) == ("OPEN_REGISTRATION_ACTIVE", "OPEN", "EPC", "招标公告")
    assert full["missing"] == ["project_code"] and full["needs_review"]
    assert len(empty["missing"]) == 6 and empty["status"] == "UNKNOWN"
    found = {x["field_name"]: x for x in notices.evidence_of(out).where("url like '%notice'").collect()}
    assert {"registration_deadline", "document_deadline", "bid_deadline", "open_time"} <= found.keys()
    assert found["bid_deadline"]["raw_value"] == "投标截止时间：2026年9月10日17:00" and found["owner"]["source_text"] in TEXT


@pytest.mark.parametrize(
    "text, want",
    [
        ("报名截止：9月5日；投标截止：9月10日", [dt(2026, 9, 5, 17), dt(2026, 9, 10, 17)]),
        ("2026年9月5日 下午5点，2026-09-05 17:00", [dt(2026, 9, 5, 17)]),
        ("2026年13月40日", []),
        ("", []),
    ],
)
def test_dates_in(spark, text, want):
    assert one(spark, X.dates_in(F.lit(text), 2026)) == want


@pytest.mark.parametrize(
    "title, want",
    [
        ("3.31元/瓦丨陕西82.5MW屋顶分布式光伏项目EPC总包中标候选人公示", "陕西82.5MW屋顶分布式光伏项目EPC总包"),
        ("【招标公告】关于哈密储能系统项目招标公告", "哈密储能系统项目"),
        ("3.31元/瓦丨项目", None),
        ("2026-08", None),
        (None, None),
    ],
)
def test_canonical_name(spark, title, want):
    assert one(spark, X.canonical_name(F.lit(title).cast("string"))) == want


def test_identity(spark):
    got = lambda t, x=None, m=None: one(spark, X.identity(F.lit(t), F.lit(x).cast("string"), m))
    named = "3.31元/瓦丨陕西82.5MW屋顶分布式光伏项目EPC总包中标候选人公示"
    r = got(named, "招标人：陕西能源有限公司")
    assert (r["identity_status"], r["confidence"], r["tenderer"]) == ("RESOLVED", 0.85, "陕西能源有限公司")
    assert got(named)["identity_status"] == "PARTIAL"
    r = got("3.31元/瓦丨项目")
    assert (r["identity_status"], r["query_seed"]) == ("AMBIGUOUS", None)
    r = got("项目", "项目编号：P-2026-001。建设地点：渭南市")
    assert (r["project_code"], r["identity_status"], r["location_hint"]) == ("P-2026-001", "RESOLVED", "渭南市")
    r = got("渭南光伏项目", "招标编号：A-100", F.create_map(F.lit("tender_code"), F.lit("B-200")))
    assert (r["tender_code"], r["location_hint"]) == ("B-200", "渭南光伏项目")


@pytest.mark.parametrize(
    "text, want",
    [
        ("当雄800MW光伏+100MW光热一体化EPC", "PROJECT_LEVEL_EPC"),
        ("昌都江达50MW光伏项目 可研及地形测绘", "EARLY_STAGE_TRACKING"),
        ("某光伏项目已竣工验收，未发现新的光伏支架采购公告", "COMPLETED_INSTALLATION_SIGNAL"),
        ("光伏项目 箱变用钢结构平台采购", "ADJACENT_STRUCTURE"),
        ("哈密光伏项目光伏支架采购招标公告", None),
        ("普通道路工程EPC", None),
        (None, None),
    ],
)
def test_lead_type(spark, text, want):
    assert one(spark, L.lead_type(F.lit(text).cast("string"))) == want


def test_follow_ups(spark):
    assert one(spark, L.lead_identity(F.lit("【转载】当雄光热EPC项目招标公告 - 某网"))) == "当雄光热EPC项目"
    assert one(spark, L.follow_ups(F.lit("甲项目"), F.lit("PROJECT_LEVEL_EPC"))) == ['"甲项目" 支架 设备材料', '"甲项目" 招标文件', '"甲项目" 组件支架']
    assert one(spark, L.follow_ups(F.lit(None).cast("string"), F.lit("PROJECT_LEVEL_EPC"))) == []
    assert one(spark, L.verification_queries(F.lit("甲"), F.lit("T1"), F.lit("T1"), F.lit(" "), F.lit("丙"))) == ["甲", "T1", "丙", '"甲" 招标', '"甲" 延期', '"甲" 变更', '"甲" 澄清', '"T1" 延期', '"T1" 变更', '"丙" "甲"']
    made = one(spark, L.enrichment_queries(*[F.lit(x) for x in ("哈密储能项目", "P1", "T1", "甲公司", "乙代理")]))
    assert len(made) == 18 and made[5]["query_text"] == '"甲公司" 哈密'
    assert one(spark, L.enrichment_queries(F.lit("短"), *[F.lit(None).cast("string")] * 4)) == []
    act = lambda b, i, v, m: one(spark, L.next_action(*[F.lit(x).cast("string") for x in (b, i, v)], F.array(*[F.lit(x) for x in m]).cast("array<string>")))
    assert act("HTTP_412", "AMBIGUOUS", None, []) == "VERIFY_BY_HAND" and act("DATE_CONFLICT", "AMBIGUOUS", None, []) == "CONFIRM_IDENTITY"
    assert act(None, "RESOLVED", "SECONDARY_ONLY", []) == "TRACE_OFFICIAL" and act(None, None, None, ["owner"]) == "FILL:owner" and act(None, None, None, []) == "WATCH"


def test_review(spark):
    fields = "status string, reason_code string, source_level string, identity_conflict boolean, field_conflict boolean, parse_failed boolean, low_quality_pdf boolean, unproven boolean, qualification_deadline timestamp_ntz, registration_deadline timestamp_ntz, document_deadline timestamp_ntz, bid_deadline timestamp_ntz, open_time timestamp_ntz"
    soon = dt(2026, 8, 30)
    df = spark.createDataFrame([("UNKNOWN", "X", "d", False, False, False, False, True, None, None, None, soon, None), ("OPEN", "Y", "A", None, True, True, True, False, None, None, None, None, None)], fields)
    rows = df.select(L.review_reasons(now()).alias("r"), L.verification_reasons().alias("v"), L.review_priority(L.review_reasons(now()), F.lit(120.0), F.lit(None).cast("double"), F.col("status")).alias("p")).collect()
    assert rows[0]["r"] == ["SOURCE_INCOMPLETE", "UNKNOWN_PARTICIPATION_RULE", "MISSING_CRITICAL_EVIDENCE", "ONLY_SECONDARY_SOURCE", "DEADLINE_WITHIN_3_DAYS"] and rows[0]["p"] == 1
    assert rows[1]["r"] == ["CONFLICTING_DATE", "UNKNOWN_DOCUMENT_PARSE_FAILED", "PDF_PARSE_LOW_QUALITY", "OPEN_PARTICIPATION_UNCLEAR"]
    assert rows[0]["v"] == ["UNKNOWN_STATUS", "LOW_SOURCE_LEVEL", "REGISTRATION_UNCLEAR"]


@pytest.mark.parametrize("text, path", [("陕西省西安市雁塔区光伏项目", ["陕西省", "西安市", "雁塔区"]), ("青海省海西州德令哈市", ["青海省", "海西蒙古族藏族自治州"]), ("华东某项目", None), (None, None)])
def test_places(spark, text, path):
    got = one(spark, PLACES.match(F.lit(text).cast("string")))
    assert (got and got["path"]) == path


def test_region_tree(spark):
    assert {e["code"] for e in PLACES.selected(["61"], ["610113"])} == {"61", "6101"}
    with pytest.raises(ValueError):
        Places([*PLACES.entries, {"code": "61", "name": "x", "level": "city"}])
    passes = lambda *a, **k: one(spark, region_passes(*[F.lit(x) for x in a], **k))
    assert passes("陕西", "陕西省", "陕西省西安市") and not passes("青海", "陕西省", "陕西省") and passes("青海", "", "") and not passes("青海", "", "", exact=True)


def test_candidates(spark):
    schema = "candidate_key string, candidate_values map<string,string>, source_level string, relevance_class string, identity_status string, identity_confidence double, official_found boolean, content_hash string, enrichment_state string, first_seen_at int, last_seen_at int, last_change_at int"
    old = spark.createDataFrame([("a", {"owner": "甲", "scope": "x"}, "B", "DIRECT", "RESOLVED", 1.0, True, "h1", "COMPLETE", 1, 1, 1), ("b", {}, "E", "POSSIBLE", "PARTIAL", 0.6, False, "h", "USABLE", 1, 1, 1)], schema)
    new = spark.createDataFrame([("a", {"owner": "乙", "scope": "y", "agency": "丙"}, "D", "POSSIBLE", "AMBIGUOUS", 0.1, False, "h2", None, None, 5, None), ("c", {"owner": " "}, "A", "DIRECT", "PARTIAL", 0.6, True, "h3", None, None, 5, None)], schema)
    got = {r["candidate_key"]: r for r in merge.upsert_candidates(old, new).collect()}
    a = got["a"]
    assert a["candidate_values"] == {"owner": "甲", "scope": "y", "agency": "丙"} and (a["source_level"], a["relevance_class"], a["identity_status"], a["official_found"]) == ("B", "DIRECT", "RESOLVED", True)
    assert (a["enrichment_state"], a["first_seen_at"], a["last_seen_at"], a["last_change_at"]) == ("AMBIGUOUS", 1, 5, 5)
    assert got["b"]["enrichment_state"] == "USABLE" and got["b"]["last_change_at"] == 1 and got["c"]["first_seen_at"] == 5
    again = merge.upsert_candidates(merge.upsert_candidates(old, new), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_merges(spark):
    projects = spark.createDataFrame([(1, None, "x", 10), (2, "甲", "y", 5), (3, "丙", None, 1)], "id int, owner string, code string, created int")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id int, canonical_id int")
    assert sorted(map(tuple, merge.merge_projects(projects, members, "id", ["created"]).collect())) == [(1, "甲", "x", 10, 2), (3, "丙", None, 1, 1)]
    links = spark.createDataFrame([(1, "s", None), (2, "s", "u"), (9, "s", "w")], "id int, source string, url string")
    assert sorted(map(tuple, merge.repoint(links, members, "id", ["source"]).collect())) == [(1, "s", "u"), (9, "s", "w")]
    old = spark.createDataFrame([(1, None, "v")], "id int, field string, value string")
    new = spark.createDataFrame([(1, None, "v"), (1, "f", "v"), (1, "f", "v")], "id int, field string, value string")
    assert sorted(map(str, merge.insert_if_absent(old, new, ["id", "field", "value"]).collect())) == sorted(map(str, [*old.collect(), new.collect()[1]]))
    auto = spark.createDataFrame([(1, "a", "v1"), (2, "a", "v2")], "id int, field string, value string")
    events = spark.createDataFrame([(1, "a", "m", 1), (2, "a", "m", 1), (2, "a", None, 2)], "id int, field string, manual_value string, changed_at int")
    assert {r["id"]: r["effective"] for r in merge.effective_values(auto, events, ["id", "field"]).collect()} == {1: "m", 2: "v2"}
    after = projects.withColumn("owner", F.when(F.col("id") == 1, "丁").otherwise(F.col("owner")))
    assert [tuple(r) for r in merge.project_changes(projects, after, "id", ["owner", "code"]).collect()] == [(1, "owner", None, "丁")]


def test_enrichment(spark):
    none = None
    candidates = spark.createDataFrame([(1, "哈密储能项目", none, none, none, none), (2, "短", none, none, none, none)], "candidate_id int, name string, project_code string, tender_code string, tenderer string, agency string")
    index = spark.createDataFrame(
        [('"哈密储能项目"', "u1", none, "P1", none, none, none), ('"P1" PDF', "u2", none, none, none, "甲公司", "乙代理"), ('"P1"', "u3", none, "P2", none, none, none)],
        "query_text string, url string, name string, project_code string, tender_code string, tenderer string, agency string",
    )
    known, asked = enrich.enrichment_rounds(candidates, index, most_queries=40)
    got = {r["candidate_id"]: r for r in known.collect()}
    assert (got[1]["project_code"], got[1]["tenderer"], got[1]["agency"]) == ("P1", "甲公司", "乙代理") and got[2]["project_code"] is None
    rows = asked.collect()
    assert len({(r["candidate_id"], r["query_text"]) for r in rows}) == len(rows) and max(r["round"] for r in rows) == 3 and {r["candidate_id"] for r in rows} == {1}
    assert enrich.enrichment_rounds(candidates, index, most_queries=3)[1].count() == 3


def test_tracing(spark):
    leads = spark.createDataFrame([(1, "哈密储能系统采购", ["T-1"], "甲"), (2, "", [], ""), (3, "银川风电工程", [], ""), (4, "兰州光伏工程", [], "")], "lead_id int, name string, codes array<string>, owner string")
    index = spark.createDataFrame(
        [('"T-1" 招标公告', 1, "http://x", "别的", True, False), ('"哈密储能系统采购" 招标公告', 2, "http://y", "哈密储能系统 采购", True, False), ('"银川风电工程" 招标公告', 1, "http://z", "", True, True)],
        "query_text string, place int, url string, text string, is_official boolean, blocked boolean",
    )
    got = {r["lead_id"]: (r["status"], r["official_url"]) for r in enrich.trace_official(leads, index).collect()}
    assert got == {1: ("FOUND_OFFICIAL", "http://y"), 2: ("NO_IDENTITY", None), 3: ("BLOCKED", None), 4: ("NOT_FOUND", None)}


def test_source_plan(spark):
    schema = "source_id string, priority int, enabled boolean, crawl_enabled boolean, adapter string, adapter_level string, access_method string, manual_action string"
    df = spark.createDataFrame([("a", 2, True, True, "x", "SITE", "http", None), ("b", 1, True, True, "configured", "SITE", "http", None), ("c", 1, False, True, "x", "SITE", "http", "LOGIN"), ("d", 1, True, True, "x", "SITE", "http", "LOGIN"), ("e", 1, True, True, "x", "catalog", "http", None)], schema)
    got = {r["source_id"]: r["reason"] for r in notices.source_plan(df, F.lit(True)).collect()}
    assert got == {"a": "READY", "b": "ADAPTER_NOT_CONFIGURED", "c": "DISABLED", "d": "MANUAL_ACTION_REQUIRED", "e": "CATALOG_ONLY"}
    assert notices.source_plan(df, F.lit(True)).orderBy("plan_rank").first()["source_id"] == "a"


def test_request():
    r = request.parse("内蒙古最近30天光伏储能，只看还能参与的", {"内蒙古": "内蒙古自治区", "内蒙古自治区": "内蒙古自治区"})
    assert (r.regions, r.days, r.industries, r.only_open) == (("内蒙古自治区",), 30, ("solar", "storage"), True)
    assert request.parse("给我完整结果").result_mode == "FULL_RESULT" and request.parse("最近新增项目").result_mode == "DELTA_RESULT"
    asked = request.parse("光伏")
    assert replace(asked, deep=True, only_open=True).scope_key() == asked.scope_key()
    assert request.parse("光伏").scope_key() != request.parse("储能").scope_key()
    assert request.parse("火星项目").regions == ()
