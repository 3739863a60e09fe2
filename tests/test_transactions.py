"""Batches of projects as one commit, and the document closure that is stopped and started again."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators.transactions import STAGES, closure_run, commit_projects
from tidemark.sources.store import Change, Store, new_folder

def at():
    return F.lit("2026-08-01 12:00:00").cast("timestamp_ntz")


@pytest.fixture
def store(spark):
    return Store(spark, new_folder(spark, "projects"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "project_id int, owner string, bid_deadline string, status string")


def read(snapshot, table, *columns):
    return sorted((tuple(r[c] for c in columns) for r in snapshot.table(table).collect()), key=repr)


def test_a_batch_is_one_commit(spark, store):
    first = commit_projects(store, batch(spark, [(1, "a", "d1", "OPEN"), (2, "b", "d2", "CLOSED"), (3, "c", None, "UNKNOWN")]), ["bid_deadline"], at())
    assert {r.lifecycle_state for r in first.table("projects").collect()} == {"NEW"} and read(first, "changes", "project_id") == []
    store.commit(first, [Change("overrides", spark.createDataFrame([(1, "owner", "a", "manual", True)], "project_id int, field_name string, automatic_value string, manual_value string, active boolean"), ("project_id",))])
    again = [(1, "changed", "d9", "OPEN"), (2, "b", "d2", "OPEN"), (4, None, "d4", "OPEN")]
    proof = spark.createDataFrame([(1, "owner", "u", "changed", "raw", "text", 0.8)], "project_id int, field_name string, url string, normalized_value string, raw_value string, source_text string, confidence double")
    after = commit_projects(store, batch(spark, again), ["bid_deadline"], at(), "extension", proof)
    assert read(after, "projects", "project_id", "owner", "lifecycle_state") == [(1, "a", "UPDATED"), (2, "b", "REOPENED"), (3, "c", "NEW"), (4, None, "NEW")]
    assert read(after, "changes", "project_id", "change_type", "field_name", "old_value", "new_value") == [(1, "extension", "bid_deadline", "d1", "d9")]
    assert read(after, "overrides", "automatic_value", "manual_value") == [("changed", "manual")] and read(after, "evidence", "project_id", "field_name") == [(1, "owner")]
    assert len(read(after, "statuses", "project_id")) == 5
    same = commit_projects(store, batch(spark, again), ["bid_deadline"], at(), "extension", proof)
    for table in ("changes", "statuses", "evidence"):
        assert same.table(table).count() == after.table(table).count()
    with pytest.raises(ValueError, match="no kind"):
        commit_projects(store, batch(spark, again), ["bid_deadline"], at(), "rumour")


def test_a_batch_that_fails_leaves_nothing(spark, store):
    base = commit_projects(store, batch(spark, [(1, "a", "d1", "OPEN")]), ["bid_deadline"], at())
    broken = batch(spark, [(1, "b", "d2", "CLOSED")])
    proof = spark.createDataFrame([(1, "owner", "u", "x", "r", "t", 0.1)], "project_id int, field_name string, url string, normalized_value string, raw_value string, source_text string, confidence double").withColumn("raw_value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commit_projects(store, broken, ["bid_deadline"], at(), evidence=proof)
    assert store.snapshot().version == base.version and read(store.snapshot(), "projects", "owner") == [("a",)]


def archive(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("_", "."), text)
    return bytearray(data.getvalue())


def docx(*lines):
    body = "".join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)
    return archive(**{"word/document_xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


PAGE = "<html><body><h1>甲县光伏项目招标公告</h1><article><a href='/f/one.docx'>附件</a> <a href='/f/all.zip'>包</a> <a href='/f/gone.pdf'>无</a><p>项目名称：甲县光伏项目</p><p>招标人：甲公司</p></article></body></html>"
LANDED = [
    ("https://h.cn/1.html", PAGE, "text/html", None), ("https://h.cn/2.html", "<html><body><h1>乙</h1><article>没有附件</article></body></html>", "text/html", None),
    ("https://h.cn/3.html", None, None, "TIMEOUT"),
]


@pytest.fixture
def inputs(spark):
    landed = [(u, bytearray(c.encode()) if c is not None else None, t, e) for u, c, t, e in LANDED] + [
        ("https://h.cn/f/one.docx", docx("招标编号：T-100", "投标截止时间：2026年9月1日17时"), "application/octet-stream", None), ("https://h.cn/f/all.zip", archive(a_txt="招标代理机构：丙公司\n预算金额：100万元", b_exe="x"), "application/zip", None)
    ]
    return (
        spark.createDataFrame([("c1", {"owner": "", "project_name": "已知"}, None), ("c2", None, None), ("c3", None, None), ("c4", None, None)], "candidate_id string, candidate_values map<string,string>, blocker string"),
        spark.createDataFrame([("c1", 1, "https://h.cn/1.html"), ("c2", 2, "https://h.cn/2.html"), ("c3", 3, "https://h.cn/3.html"), ("zz", 4, "https://h.cn/1.html")], "candidate_id string, result_id int, url string"),
        spark.createDataFrame(landed, "url string, content binary, content_type string, error string"),
    )


def state(store):
    now = store.snapshot()
    return {t: sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True, ensure_ascii=False) for r in now.table(t).collect()) for t in now.tables}


def test_closure(spark, store, inputs):
    after = closure_run(store, *inputs, 2026, at())
    rows = {r.candidate_id: r for r in after.table("candidates").collect()}
    c1 = rows["c1"]
    assert c1.candidate_values["owner"] == "甲公司" and c1.candidate_values["project_name"] == "已知" and c1.candidate_values["agency"] == "丙公司" and c1.candidate_values["project_code"] == "T-100"
    assert c1.candidate_values["bid_deadline"].startswith("2026-09-01 17:00") and c1.documents_read == 3 and c1.blocker is None and c1.status in ("OPEN", "UNKNOWN")
    assert rows["c2"].blocker == "MISSING_ATTACHMENT" and rows["c3"].documents_read == 0 and rows["c4"].blocker is None and rows["c4"].enrichment_state == "PARTIAL"
    found = {r.url: r.download_status for r in after.table("attachments").collect()}
    assert found == {"https://h.cn/f/one.docx": "DOWNLOADED", "https://h.cn/f/all.zip": "DOWNLOADED", "https://h.cn/f/gone.pdf": "DISCOVERED"}
    assert {r.field_name for r in after.table("evidence").where("member = 'a.txt'").collect()} >= {"agency", "budget"}
    assert after.table("snapshots").where("candidate_id = 'zz'").count() == 0


def test_closure_is_taken_up_where_it_stopped(spark, store, inputs, monkeypatch):
    whole = Store(spark, new_folder(spark, "whole"))
    closure_run(whole, *inputs, 2026, at())
    for stage in STAGES:  # stopped after each stage, and started again from the first
        closure_run(store, *inputs, 2026, at(), until=stage)
    assert state(store) == state(whole)
    parsed = store.snapshot().table("parses").count()
    from tidemark.sources import files

    monkeypatch.setattr(files, "texts_of", lambda suffix, data: [(None, None, "READ_AGAIN")])
    closure_run(store, *inputs, 2026, at())
    assert store.snapshot().table("parses").count() == parsed and state(store) == state(whole)


def test_closure_with_more_landed(spark, store, inputs):
    candidates, results, landed = inputs
    closure_run(store, candidates, results, landed, 2026, at())
    more = landed.unionByName(spark.createDataFrame([("https://h.cn/f/gone.pdf", None, None, "HTTP_404")], landed.schema)).where("url <> 'https://h.cn/2.html'")
    after = closure_run(store, candidates, results, more, 2026, at())
    assert {r.candidate_id: r.blocker for r in after.table("candidates").collect()}["c1"] == "ATTACHMENT_FAILED"
    assert {r.url: r.download_status for r in after.table("attachments").collect()}["https://h.cn/f/gone.pdf"] == "FAILED"
