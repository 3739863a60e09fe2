"""Connectors, details, incremental cuts and whole runs over landed answers and pages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import landing as L
from tidemark.sources import html as H

NOW = dt.datetime(2026, 8, 28, 12)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ({"data": {"records": [{"a": 1}, {"a": 2}]}}, [1, 2]), ([{"a": 3}, "x"], [3]), ({"result": json.dumps({"records": [{"a": 4}]})}, [4]), ({"records": [], "content": {"list": [{"a": 5}]}}, [5]),
        ({"items": {"rows": {"data": [{"a": 6}]}}}, [6]), ({"other": [{"a": 7}]}, []), ("{broken", []), ("", []), (None, []),
    ],
)
def test_json_records(spark, body, want):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    got = spark.range(1).select(L.json_records(F.lit(text).cast("string")).alias("x")).first().x
    assert [json.loads(r)["a"] for r in got] == want


def test_connectors(spark):
    body = lambda *rows: json.dumps({"data": {"records": list(rows)}}, ensure_ascii=False)
    answers = spark.createDataFrame(
        [(2, "u", body({"t": "光伏 <b>甲</b>", "i": "/jyxx/9", "d": "2026-08-01"})), (1, "u", body({"t": "光伏 甲", "i": "/jyxx/9", "d": "2026-08-02 10:00"}, {"t": "", "i": "/x"}, {"t": "风电", "i": "8"}))], "page int, url string, body string"
    )
    c = L.Connector("s", base_url="https://h.cn/a/", fields={"title": ("t",), "url": ("i",), "published_at": ("d",)}, rewrite=("/jyxx/", "/new/"))
    got = {r.url: r for r in L.listed_items(answers, c, 2026).collect()}
    assert set(got) == {"https://h.cn/new/9", "https://h.cn/a/8"} and got["https://h.cn/new/9"].published_at == dt.datetime(2026, 8, 2, 10) and got["https://h.cn/a/8"].title == "风电"
    assert [r.title for r in L.listed_items(answers, c, 2026, terms="光伏 甲").collect()] == ["光伏 甲"]
    by_id = L.Connector("s", fields=c.fields, detail="https://h.cn/d?id={}")
    assert "https://h.cn/d?id=8" in {r.url for r in L.listed_items(answers, by_id, 2026).collect()}
    pages = spark.createDataFrame([(1, "https://h.cn/l/", "<ul><li><a href='1.html'>甲</a> 2026-08-03</li></ul>")], "page int, url string, body string")
    row = L.listed_items(pages, L.Connector("h", kind="html", page=H.ListPage()), 2026).first()
    assert (row.source_id, row.url, row.published_at) == ("h", "https://h.cn/l/1.html", dt.datetime(2026, 8, 3, 17))
    assert L.listed_items(pages, L.Connector("n", kind="none"), 2026).count() == 0
    known = {"ggzy": c}
    assert L.connector_of({"source_id": "s", "adapter": "ggzy"}, known) == c and L.connector_of({"source_id": "b", "adapter": "ggzy", "adapter_level": "CUSTOM_BROWSER"}, known).kind == "none"
    assert L.connector_of({"source_id": "g", "adapter": "generic:x"}, known).kind == "html" and L.connector_of({"source_id": "o", "adapter": "configured"}, known).kind == "none"


def test_since(spark):
    d = dt.datetime
    items = spark.createDataFrame([(1, "a", d(2026, 8, 1)), (2, "a", d(2026, 8, 26)), (3, "a", None), (4, "b", d(2026, 8, 1)), (5, "c", d(2026, 7, 1))], "id int, source_id string, published_at timestamp_ntz")
    state = spark.createDataFrame([("a", d(2026, 8, 20)), ("b", None)], "source_id string, last_success_at timestamp_ntz")
    ids = lambda **k: sorted(r.id for r in L.since(items, state, now(), 30, **k).collect())
    assert ids() == [2, 3, 4] and ids(asked=30) == [1, 2, 3, 4] and ids(asked=90) == [1, 2, 3, 4, 5]


PAGE = """<title>T</title><h1>哈密储能EPC项目招标公告</h1><div class="content"><table><tr><td>项目编号</td><td>P-1</td></tr></table>
<p>项目名称：哈密储能EPC项目 招标人：新疆能源有限公司 投标截止时间：2026年9月10日17:00</p><a href="/f/a.pdf">附件</a></div>"""


def test_details(spark):
    items = spark.createDataFrame([("https://h.cn/1", "t1"), ("https://h.cn/2", "t2"), ("https://h.cn/3", "t3")], "url string, title string")
    pages = spark.createDataFrame([("https://h.cn/1", PAGE, None), ("https://h.cn/2", PAGE, "https://login.cn/")], "url string, html string, final_url string")
    got = {r.url: r for r in L.details(items, pages).collect()}
    one = got["https://h.cn/1"]
    assert one.title == "哈密储能EPC项目招标公告" and one.metadata["projectnum"] == "P-1" and "招标人：新疆能源有限公司" in one.text and [tuple(a) for a in one.attachments] == [("https://h.cn/f/a.pdf", "a.pdf")]
    assert got["https://h.cn/2"].text is None and got["https://h.cn/3"].title == "t3"


def test_provider_results(spark):
    df = spark.createDataFrame([("https://mp.weixin.qq.com/s", "a"), ("https://x.cn/", "b"), ("", "c"), ("https://y.cn", " ")], "url string, title string")
    assert L.provider_results(df).count() == 2 and [r.title for r in L.provider_results(df, wechat=True).collect()] == ["a"]


def test_lists_and_tokens(spark):
    d = dt.datetime
    rows = [(1, "哈密 储能", "OPEN", "NEW", d(2026, 8, 28, 8), None, True, False), (2, "兰州 储能", "CLOSED", "REOPENED", d(2026, 8, 1), d(2026, 8, 28, 9), False, None), (3, "哈密", "OPEN", "NEW", d(2026, 8, 28, 8), None, False, True)]
    df = spark.createDataFrame(rows, "project_id int, project_name string, status string, lifecycle_state string, created_at timestamp_ntz, last_change_at timestamp_ntz, favorite boolean, ignored boolean")
    day = F.lit(d(2026, 8, 28)).cast("timestamp_ntz")
    ids = lambda **k: sorted(r.project_id for r in L.project_list(df, day, **k).collect())
    assert ids() == [1, 2] and ids(text="储能 哈密") == [1] and ids(status="closed") == [2] and ids(view="today-new") == [1] and ids(view="today-changed") == [2] and ids(view="reopened") == [2] and ids(view="favorite") == [1] and ids(view="ignored") == [3]
    notes = spark.createDataFrame([(2, 1, d(2026, 8, 1), "late Notice")], "project_id int, id int, published_at timestamp_ntz, clean_text string")
    tokens = L.token_table(df, notes, ["project_name"])
    assert [r.project_id for r in L.find_by_tokens(tokens, "notice 储能").collect()] == [2] and L.find_by_tokens(tokens, " ").count() == 0
    assert L.by_key(df, "project_id", 2).first().project_name == "兰州 储能" and L.by_key(df, "project_id", 9).count() == 0
    assert L.missing_tables(spark, ["nowhere_at_all"]) == ["nowhere_at_all"]


def test_extraction_run(spark):
    text = "项目编号：P-1 招标人：甲公司 投标截止时间：2026年9月10日17:00"
    rows = [
        (1, "h", "h", "SUCCESS", "v1", "https://a/1", "甲项目招标公告", text, None, "original", NOW), (2, None, None, None, None, "https://a/2", "甲项目延期公告", text.replace("10日", "12日"), None, "extension", NOW),
        (3, None, None, None, None, "https://a/3", "t", None, "BROKEN_DOCUMENT", "original", NOW), (4, None, None, None, None, "https://a/4", "t", " ", None, "original", NOW), (5, "x", "y", "SUCCESS", "v1", "https://a/5", "甲项目招标公告", text, None, "original", NOW),
    ]
    notices = spark.createDataFrame(rows, "id int, content_hash string, snapshot_hash string, extraction_status string, extraction_version string, url string, title string, text string, error string, kind string, published_at timestamp_ntz")
    parses = spark.createDataFrame([(1, None, "h", None, "p1", "SUCCESS"), (5, None, "x", None, "p1", "SUCCESS")], "announcement_id int, attachment_id string, content_hash string, source_file string, parser_version string, parse_status string")
    attached = spark.createDataFrame([], "id string, announcement_id int, content_hash string, local_path string")
    old = spark.createDataFrame([], "announcement_id int, project_id string, event_type string, event_at timestamp_ntz, title string, deadlines string, evidence_ids array<bigint>")
    made = L.extraction_run(notices, parses, attached, old, 2026, now(), "v1", "p1")
    records = made.records.collect()
    assert sorted(r.id for r in records) == [2, 5] and len({r.project_id for r in records}) == 1
    assert {r.id: r.reason for r in made.failed.collect()} == {3: "BROKEN_DOCUMENT", 4: "EMPTY_TEXT"}
    assert [(r.field_name, r.n_values) for r in made.conflicts.collect()] == [("bid_deadline", 2)]
    events = {r.announcement_id: r for r in made.events.collect()}
    assert events[2].event_type == "DEADLINE_CHANGED" and len(events[5].evidence_ids) >= 3 and '"bid_deadline":"2026-09-12' in events[2].deadlines


def test_document_closure(spark):
    candidates = spark.createDataFrame([(1, {"owner": "甲", "project_name": ""}, None), (2, None, None), (3, None, None)], "candidate_id int, candidate_values map<string,string>, blocker string")
    documents = spark.createDataFrame([(1, "u", "t", "项目名称：乙能源基地 招标人：乙公司 投标截止时间：2026年9月10日17:00", None), (2, "u", "t", None, "BROKEN_DOCUMENT")], "candidate_id int, url string, title string, text string, error string")
    facts = spark.createDataFrame([], "candidate_id int, field_name string, value string")
    out, every = L.document_closure(candidates, documents, facts, 2026, now())
    got = {r.candidate_id: r for r in out.collect()}
    assert got[1].candidate_values["owner"] == "甲" and got[1].candidate_values["project_name"] == "乙能源基地" and got[1].completeness_score == 15 + 10 + 10 + 3 + 2 and got[1].enrichment_state == "PARTIAL"
    assert (got[2].blocker, got[2].enrichment_state) == ("EXTRACTION_FAILED", "BLOCKED") and got[3].completeness_score == 0
    assert {r.field_name for r in every.collect()} == {"project_name", "owner", "bid_deadline"}


def test_sites_are_configuration(spark):
    from tidemark.operators.landing import connector_of, listed_items, metadata_of
    from tidemark.sources.sites import SITES

    read = lambda adapter, url, body, terms="": [(r.url, r.title, str(r.published_at or "")[:10]) for r in listed_items(spark.createDataFrame([(1, url, body)], "page int, url string, body string"), connector_of({"source_id": "s", "adapter": adapter, "base_url": "https://h.cn/"}, SITES), 2026, terms).orderBy("url").collect()]
    anchors = "<ul><li><a href='/cggg/dfgg/gkzb/t1.htm'>One</a> 2026-08-01</li><li><a href='/about.htm'>About</a></li></ul>"
    assert read("ccgp", "https://h.cn/cggg/", anchors) == [("https://h.cn/cggg/dfgg/gkzb/t1.htm", "One", "2026-08-01")]
    ids = "<div><a href=\"javascript:urlOpen('u-1')\">Bulletin</a> 2026-08-02</div><div><a href='/x'>other</a></div>"
    assert read("cebpubservice", "https://h.cn/", ids) == [("https://ctbpsp.com/#/bulletinDetail?uuid=u-1&inpvalue=&dataSource=0&tenderAgency=", "Bulletin", "2026-08-02")]
    assert read("gsei", "https://h.cn/", "<p><a href='/html/1336/2026-08-03/content-7.html'>G</a>2026-08-03</p><p><a href='/html/1/list.html'>no</a></p>") == [("https://h.cn/html/1336/2026-08-03/content-7.html", "G", "2026-08-03")]
    named = "<ul><li><a class='infolink' title='Whole title' href='/bidweb/001/1.html'>Whole...</a><i class='author'>C-1</i>2026-08-04</li></ul>"
    assert read("chnenergy_e_zhao", "https://h.cn/", named) == [("https://h.cn/bidweb/001/1.html", "Whole title", "2026-08-04")]
    assert read("xinjiang_ggzy", "x", '{"result": {"records": [{"title": "X", "linkurl": "https://ggzy.xinjiang.gov.cn/jyxx/1.html", "webdate": "2026-08-05"}]}}') == [("https://ggzy.xinjiang.gov.cn/xinjiangggzy_new/jyxx/1.html", "X", "2026-08-05")]
    body = '{"data": {"rows": [{"id": "a/1", "title": "P", "publishTime": "2026-08-06", "procuringEntity": "Owner", "tenderNumber": "T-1", "bidOpenTime": ""}]}}'
    assert read("powerchina", "x", body) == [("https://bid.powerchina.cn/notice/detail?id=a%2F1", "P", "2026-08-06")]
    items = listed_items(spark.createDataFrame([(1, "x", body)], "page int, url string, body string"), SITES["powerchina"], 2026)
    said = items.select(metadata_of(F.col("content"), SITES["powerchina"]).alias("m")).first().m
    assert said == {"owner": "Owner", "purchaser": "Owner", "tendercode": "T-1", "published_at": "2026-08-06", "powerchina_id": "a/1"}
    assert connector_of({"source_id": "s", "adapter": "unknown"}, SITES).kind == "none" and set(SITES) == {c.source_id for c in SITES.values()}
