"""Recall, delivery, matching and steps of runs on small literals."""

import datetime as dt
import random
from dataclasses import replace
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pieces
from tidemark.functions.rules import TIME_FIELDS
from tidemark.functions.text import normalize_identity
from tidemark.operators import findings, matching, metrics, recall, runs
from tidemark.sources import html as H

NOW = dt.datetime(2026, 8, 28, 12)
TIMES = ", ".join(f"{f} timestamp_ntz" for f in TIME_FIELDS)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def projects(spark, *rows):
    full = [(r["id"], r.get("publish"), r.get("province", ""), r.get("city", ""), r.get("name", ""), r.get("ignored", False), r.get("level", "A"), r.get("changed"), False, *[r.get(f) for f in TIME_FIELDS]) for r in rows]
    return spark.createDataFrame(full, f"project_id int, publish_time timestamp_ntz, province string, city string, project_name string, ignored boolean, source_level string, last_change_at timestamp_ntz, has_marker boolean, {TIMES}")


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), "project_id int, id int, published_at timestamp_ntz, announcement_type string, clean_text string")


CRITERIA = recall.Criteria(low="2026-07-29 12:00:00", high="2026-08-28 12:00:00", province="陕西", terms=("光伏",))


def test_recall(spark):
    d = dt.datetime
    table = projects(
        spark,
        {"id": 1, "publish": d(2026, 8, 20), "province": "陕西省", "name": "光伏 EPC 招标"}, {"id": 2, "publish": d(2026, 5, 1), "province": "陕西省", "name": "光伏 招标"},
        {"id": 3, "publish": d(2026, 5, 1), "province": "陕西省", "name": "光伏 招标"}, {"id": 4, "province": "青海省", "name": "光伏", "publish": d(2026, 8, 20)}, {"id": 5, "name": "光伏 项目"},
        {"id": 6, "publish": d(2026, 8, 20), "province": "陕西省", "name": "天气"}, {"id": 7, "publish": d(2026, 8, 20), "province": "陕西省", "name": "光伏 运维", "ignored": True}, {"id": 8, "publish": d(2026, 8, 20), "province": "陕西省", "name": "天气 二"},
    )
    announced = notes(spark, (2, 1, d(2026, 8, 26), "延期公告", "天"), (3, 1, d(2026, 6, 1), "招标公告", ""), (1, 1, None, "招标公告", "运维"))
    none = spark.createDataFrame([], "project_id int, field_name string, strength int")
    prior = spark.createDataFrame([(8, "DIRECT", 2), (8, "IRRELEVANT", 1), (6, "IRRELEVANT", 1)], "project_id int, relevance_class string, updated_at int")
    got = {r.project_id: r for r in recall.recall(table, announced, none, replace(CRITERIA, excluded=("运维",)), now(), prior).collect()}
    # an old project with a late notice returns; without dates or place one is kept; 8 was relevant before
    assert sorted(got) == [1, 2, 5, 8]
    assert got[1].matched == ["光伏", "EXCLUDED:运维"] and got[1].announcement_id == 1 and got[8].matched == [] and got[2].status == "UNKNOWN"
    exact = {r.project_id for r in recall.recall(table, announced, none, replace(CRITERIA, exact=True), now(), prior).collect()}
    assert exact == {1, 2}
    typed = {r.project_id for r in recall.recall(table, announced, none, replace(CRITERIA, announcement_types=("延期",)), now()).collect()}
    assert typed == {2}
    nationwide = {r.project_id for r in recall.recall(table, announced, none, replace(CRITERIA, province="全国"), now()).collect()}
    assert nationwide == {1, 2, 4, 5}
    coded = {r.project_id for r in recall.recall(table, announced, none, replace(CRITERIA, province="", labels=("青海省", "青海")), now()).collect()}
    assert coded == {4, 5}
    profile = {r.project_id for r in recall.recall(table, announced, none, replace(CRITERIA, province="", profile_labels=("陕西",)), now()).collect()}
    assert profile == {1, 2, 5}
    free = {r.project_id for r in recall.recall(table, announced, none, replace(CRITERIA, terms=()), now()).collect()}
    assert free == {1, 2, 5}  # without terms what is irrelevant leaves


def test_delivery(spark):
    d = dt.datetime
    schema = "project_id int, status string, source_level string, matched array<string>, last_change_at timestamp_ntz, announcement_id int"
    pool = spark.createDataFrame([(1, "OPEN", "A", ["x"], d(2026, 8, 1), 1), (2, "OPEN", "D", ["x"], d(2026, 8, 1), 1), (3, "UNKNOWN", "A", [], d(2026, 8, 1), 1), (4, "OPEN", None, ["EXCLUDED:x"], None, None), (5, "OPEN", "B", [], d(2026, 8, 27), 1), (6, "OPEN", "B", [], None, 2), (7, "OPEN", "A", [], None, 1)], schema)
    sessions = spark.createDataFrame([("s1", "k", "COMPLETED", d(2026, 8, 10), None), ("s2", "k", "PARTIAL", d(2026, 8, 9), d(2026, 8, 20)), ("s3", "other", "COMPLETED", d(2026, 8, 25), None), ("s4", "k", "FAILED", d(2026, 8, 26), None)], "session_id string, scope_key string, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    links = spark.createDataFrame([(s, p, 1, "OPEN" if p != 3 else "CLOSED") for s in ("s1", "s2", "s3", "s4") for p in (1, 2, 3, 5, 6, 7)], "session_id string, project_id int, announcement_id int, status_at_search string")
    reports = recall.last_reports(sessions, links, "k", "s9")
    assert {r.reported_at for r in reports.collect()} == {d(2026, 8, 20)}
    sources = spark.createDataFrame([(7, d(2026, 8, 21))], "project_id int, first_seen_at timestamp_ntz")
    manual = spark.createDataFrame([(1, d(2026, 8, 19))], "project_id int, changed_at timestamp_ntz")
    same = recall.unchanged(pool, reports, sources, manual)
    # 3: another status; 5: changed; 6: another notice; 7: another source
    assert sorted(r.project_id for r in same.collect()) == [1, 2]
    ids = lambda c: sorted(r.project_id for r in recall.deliver(pool, c, same).collect())
    assert ids(replace(CRITERIA, delta=True)) == [3, 5, 6, 7] and ids(CRITERIA) == [1, 2, 3, 5, 6, 7]
    assert ids(replace(CRITERIA, source_level="B", only_open=True)) == [1, 5, 6, 7]


def test_session_rows(spark):
    links = spark.createDataFrame([("s", 1, 5, "OPEN"), ("s", 2, None, "UNKNOWN"), ("t", 1, 5, "OPEN")], "session_id string, project_id int, announcement_id int, status_at_search string")
    table = spark.createDataFrame([(1, False), (2, True)], "project_id int, ignored boolean")
    announced = spark.createDataFrame([(5, "t", NOW)], "id int, title string, published_at timestamp_ntz")
    assert [(r.project_id, r.announcement_title) for r in recall.session_rows("s", links, table, announced).collect()] == [(1, "t")]
    assert len(recall.session_rows("s", links, table, announced, open_only=False, skip_ignored=False).collect()) == 2


def test_matching(spark):
    fields = "project_id int, tender_code string, project_code string, project_name string, owner string, purchaser string, province string, city string, county string, capacity_mw double, publish_time timestamp_ntz"
    name = "新疆某地集中式光伏发电项目"
    rows = [
        (1, "T-001", None, "甲项目名称一", None, None, None, None, None, None, None), (2, " T-001 ", None, "别的名称", None, None, None, None, None, None, None),
        (3, None, "P-001", "丙", None, None, None, None, None, None, None), (4, None, "P001", "丁", None, None, None, None, None, None, None),
        (5, None, None, name, "甲能源公司", None, "新疆", "哈密", None, 100.0, None), (6, None, None, name + "招标公告", None, "甲能源公司", "新疆", "哈密", None, 100.4, None),
        (7, None, None, "陕西风电项目", "甲公司", None, "陕西", None, None, None, None), (8, None, None, "青海储能电池采购", "乙公司", None, "青海", None, None, None, None),
        (9, None, None, name, None, None, "甘肃", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, fields)
    got = {(r.left_id, r.right_id): r for r in matching.match_records(df, df).collect()}
    assert {k: (r.outcome, round(r.score, 2)) for k, r in got.items()} == {
        (1, 2): ("EXACT", 100.0), (2, 1): ("EXACT", 100.0), (3, 4): ("EXACT", 99.0), (4, 3): ("EXACT", 99.0), (5, 6): ("PROBABLE", 86.67), (6, 5): ("PROBABLE", 86.67),
    }
    assert got[5, 6].signals == 3  # owner, place and capacity
    many = spark.createDataFrame([(i, "T", None, "n", None, None, None, None, None, None, None) for i in range(50)], fields)
    pairs = matching.match_records(many, many).collect()
    assert len(pairs) == 50 and {r.right_id for r in pairs} == {0, 1}  # one pair a record, however many share a code
    assert matching.classes(many).select("class_id").distinct().count() == 1


def test_containing(spark):
    cases = spark.createDataFrame([(1, ["光伏", "支架"]), (2, ["abcdefghijklmnopqrstuvwxyz"]), (3, ["x"]), (4, []), (5, ["光伏", "无"]), (6, [""])], "case_id int, terms array<string>")
    rows = spark.createDataFrame([(10, "哈密光伏项目支架采购"), (11, "zzabcdefghijklmnopqrstuvwxyzzz"), (12, "光伏"), (13, None), (14, "ax"), (15, "abcdefghijklmnopqrstuvwxy")], "row_id int, text string")
    got = sorted(map(tuple, metrics.containing(cases, rows, "case_id", "terms", "row_id", "text").collect()))
    assert got == [(1, 10), (2, 11), (3, 11), (3, 14), (3, 15)]
    words = "the quick  brown\nfox jumps over the lazy dog"
    cases = spark.createDataFrame([(1, [words[2:-2]]), (2, [words, "lazy"]), (3, ["brown fox jumps over the"]), (4, ["k  brown\nfox jumps o"]), (5, [" brown\nfox jumps over "])], "case_id int, terms array<string>")
    rows = spark.createDataFrame([(1, words), (2, "x" + words + "y"), (3, words.replace("\n", " ")), (4, words[3:])], "row_id int, text string")
    want = sorted((c.case_id, r.row_id) for c in cases.collect() for r in rows.collect() if all(t in r.text for t in c.terms))
    assert sorted(map(tuple, metrics.containing(cases, rows, "case_id", "terms", "row_id", "text").collect())) == want and len(want) == 11
    assert metrics.containing(cases.limit(0), rows, "case_id", "terms", "row_id", "text").count() == 0


def test_containing_meets_by_long_terms(spark, monkeypatch):
    """A short term makes no pieces where its case has a long one; what meets is exact for any length and place, and for cases of one id."""
    kept = {}
    monkeypatch.setattr(metrics, "saved", lambda df, tag: kept.setdefault(tag, df.localCheckpoint()))
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("ab😀\n") for _ in range(n))
    texts = [made(rng.choice([0, 1, 5, 40, 300])) for _ in range(80)]
    cut = lambda n: (lambda t, i: t[i : i + n])(rng.choice(texts), rng.randrange(40))
    terms = [[x for x in (cut(rng.choice([1, 2, 3, 7, 15, 30, 31, 32, 70])) for _ in range(rng.randint(1, 3))) if x] for _ in range(120)]
    cases = spark.createDataFrame([(i // 2, t) for i, t in enumerate(terms) if t], "case_id int, terms array<string>")
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    want = {(i // 2, k) for i, t in enumerate(terms) if t for k, x in enumerate(texts) if all(y in x for y in t)}
    assert set(map(tuple, metrics.containing(cases, rows, "case_id", "terms", "row_id", "text").collect())) == want and want
    kept.clear()
    long = "what every notice of a region says of its grid"
    cases = spark.createDataFrame([(1, ["x", long])], "case_id int, terms array<string>")
    rows = spark.createDataFrame([(k, "x" * 100) for k in range(50)] + [(50, f"x {long}")], "row_id int, text string")
    assert metrics.containing(cases, rows, "case_id", "terms", "row_id", "text").collect() == [(1, 50)]
    assert {r.row_id for r in kept["pieces"].collect()} == {50} and kept["pieces"].count() <= 3


def test_recall_by_region_reads_texts_in_pieces(spark, monkeypatch):
    """A text of n characters makes at most n / 16 pieces for cases with long terms, however many rows have their short ones."""
    kept = {}
    monkeypatch.setattr(metrics, "saved", lambda df, tag: kept.setdefault(tag, df.localCheckpoint()))
    long = "whateverynoticeofaregionsaysofitsgrid"
    shape = "case_id int, region string, title_terms array<string>, availability string, project_id int, source_url string, source_artifact string"
    cases = spark.createDataFrame([(1, "r", ["x", long], "PUBLIC", None, None, None), (2, "r", [long, "absent"], "PUBLIC", None, None, None), (3, "s", ["x"], "UNAVAILABLE", 7, None, None)], shape)
    rows = spark.createDataFrame([(k, None, "y" * 64) for k in range(40)] + [(40, None, "x" + long * 4)], "project_id int, source_url string, text string")
    artifacts = spark.createDataFrame([], "name string, text string")
    got = metrics.recall_by_region(metrics.recall_cases(cases.where("case_id < 3"), rows, artifacts)).collect()
    assert [(r.region, r.total, r.matched, r.observable, r.observable_recall) for r in got] == [("r", 2, 1, 2, 0.5)]
    assert 0 < kept["pieces"].count() <= len(long) * 4 // 16 + 1
    kept.clear()
    got = metrics.recall_by_region(metrics.recall_cases(cases, rows, artifacts)).collect()
    assert sorted((r.region, r.total, r.matched, r.observable) for r in got) == [("r", 2, 1, 2), ("s", 1, 1, 0)]


def test_recall_by_region_looks_for_equal_cases_once(spark, monkeypatch):
    """Copies of a case aren't paired with each row that holds it."""
    kept = {}
    monkeypatch.setattr(metrics, "saved", lambda df, tag: kept.setdefault(tag, df.localCheckpoint()))
    title = ["What every NOTICE", "of a region, says of its GRİD at 300 Kelvin—today"]
    shape = "case_id int, region string, title_terms array<string>, availability string, project_id int, source_url string, source_artifact string"
    cases = spark.createDataFrame([(k, f"r{k % 2}", title if k else ["哈密光伏", "é"], "PUBLIC", None, None, None) for k in range(21)], shape)
    held = "x\u3000what every  notice（of a region）says of its gri̇d at 300 kelvin today"
    rows = spark.createDataFrame([(k, None, held if k % 2 else "哈密·光伏") for k in range(1, 31)] + [(31, None, None), (32, None, "é 哈密 光伏")], "project_id int, source_url string, text string")
    artifacts = spark.createDataFrame([], "name string, text string")
    found = metrics.recall_cases(cases, rows, artifacts)
    assert {(r.case_id, r.matched_project_id) for r in found.collect()} == {(k, 1 if k else 32) for k in range(21)}
    assert kept["met"].count() <= 15 + 16
    assert sorted((r.region, r.total, r.matched) for r in metrics.recall_by_region(found).collect()) == [("r0", 11, 11), ("r1", 10, 10)]


def test_folding_keeps_what_normalising_keeps(spark):
    """Each character folds as what lower-casing or dropping it leaves, so pieces of raw texts are pieces of normalised ones."""
    table = pieces.fold_table()
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    made = spark.createDataFrame([(c,) for c in points if c.isspace() or table[ord(c)] or c.lower() != c], "c string").select("c", normalize_identity(F.col("c")).alias("n")).collect()
    fold = lambda t: "".join(map(chr, pieces.folded([t], table)[0]))
    assert [r.c for r in made if fold(r.c) != fold(r.n)] == [] and fold("\u212aİAz9 光—é") == "kiaz9光"
    codes, starts = pieces.folded(["", "a b", "", "é", "cd"], table)
    assert (codes.tobytes().decode("utf-16-le"), starts.tolist()) == ("abcd", [0, 0, 2, 2, 2])


@pytest.mark.parametrize("n", [1, 3, 5, 9])
def test_review_sample(spark, n):
    tags = {1: ["UNKNOWN"], 2: ["OPEN", "PDF"], 3: ["OPEN"], 4: ["PDF", "CHANGE"], 5: [], 6: ["CHANGE"], 7: ["SECONDARY_SOURCE"]}
    order = []
    for tag in metrics.SAMPLE_TAGS:
        fresh = [i for i in sorted(tags) if tag in tags[i] and i not in order]
        order += fresh[:1]
    order += [i for i in sorted(tags) if i not in order]
    df = spark.createDataFrame(list(tags.items()), "id int, tags array<string>")
    assert sorted(r.id for r in metrics.review_sample(df, "id", "tags", n).collect()) == sorted(order[:n])


def test_corrections(spark):
    overrides = spark.createDataFrame([(1, "owner", "a", "m", NOW, True)], "project_id int, field_name string, automatic_value string, manual_value string, changed_at timestamp_ntz, active boolean")
    asked = lambda *r: spark.createDataFrame([r], "project_id int, field_name string, value string, evidence_text string, source_url string")
    conflicts = spark.createDataFrame([(1, "owner", "PENDING"), (1, "budget", "PENDING")], "project_id int, field_name string, resolution_status string")
    made, proof, settled = runs.corrections(overrides, asked(1, "owner", " n ", "text", "http://x"), conflicts, 2026, now())
    assert sorted((r.manual_value, r.active, r.automatic_value) for r in made.collect()) == [("m", False, "a"), ("n", True, "a")]
    assert proof.first().extractor_type == "CODEX_REVIEW" and {r.field_name: r.resolution_status for r in settled.collect()} == {"owner": "RESOLVED", "budget": "PENDING"}
    for wrong in ((1, "status", "OPEN", "t", "u"), (1, "owner", "n", " ", "u"), (1, "owner", "n", "t", "")):
        with pytest.raises(Exception, match="needs a fact"):
            runs.corrections(overrides, asked(*wrong), conflicts, 2026, now())[0].collect()
    assert not runs.cleared(overrides, overrides).first().active


def test_histories_and_reviews_check_their_values(spark):
    old = spark.createDataFrame([(1, "change")], "id int, change_type string")
    assert runs.history(old, spark.createDataFrame([(2, "extension")], "id int, change_type string")).count() == 2
    with pytest.raises(Exception, match="unknown change"):
        runs.history(old, spark.createDataFrame([(2, "other")], "id int, change_type string")).collect()
    items = spark.createDataFrame([("r", "PENDING", None, None)], "review_id string, status string, resolution string, resolved_at timestamp_ntz")
    decide = lambda s: spark.createDataFrame([("r", s, "n")], "review_id string, decision string, note string")
    assert runs.resolve_reviews(items, decide("SKIPPED"), now()).first().resolved_at == NOW and runs.resolve_reviews(items, decide("PENDING"), now()).first().resolved_at is None
    with pytest.raises(Exception, match="unknown review state"):
        runs.resolve_reviews(items, decide("DONE"), now()).collect()


def test_chains_of_codes(spark):
    rows = [(i, f"t{i // 2}" if i < 20 else None, f"p{(i + 1) // 2}" if i < 20 else "") for i in range(25)]
    df = spark.createDataFrame(rows, "project_id int, tender_code string, project_code string")
    got = {r.project_id: r.canonical_id for r in runs.merged_codes(df).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(25)}


def test_findings(spark):
    rows = [("http://www.a.gov.cn/x?utm_source=1", "光伏 招标", "", {}), ("https://www.a.gov.cn/x", "光伏 招标", "", {}), ("https://mp.weixin.qq.com/s", "光伏项目EPC总包", "", {"项目编号": "P-1"}), ("", "x", "", {}), ("https://b.cn/", "天气", "", {})]
    got = {r.canonical_url: r for r in findings.findings(spark.createDataFrame(rows, "url string, title string, snippet string, metadata map<string,string>"), ["b.cn"]).collect()}
    assert set(got) == {"https://www.a.gov.cn/x", "https://mp.weixin.qq.com/s", "https://b.cn/"}
    a, w, b = got["https://www.a.gov.cn/x"], got["https://mp.weixin.qq.com/s"], got["https://b.cn/"]
    assert (a.is_candidate, a.is_official, a.is_secondary, a.source_level) == (True, True, False, "A")
    assert (w.lead_type, w.is_secondary, w.source_level, w.project_code) == ("PROJECT_LEVEL_EPC", True, "B", "P-1") and (b.is_candidate, b.is_official) == (False, True)
    named = lambda n, t, x: one(spark, findings.search_identity(F.lit(n).cast("string"), F.lit(t), F.lit(x)))
    assert named("哈密项目一期", "t", "") == "哈密项目一期" and named("x", "t", "项目名称：甲乙丙丁项目，") == "甲乙丙丁项目" and named(None, "【转载】甲项目招标公告 - 网", "") == "甲项目"


def test_inspection(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, name string")
    kids = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (2, 3, "z")], "project_id int, id int, text string")
    r = findings.inspection(df, {"notes": (kids, ["id"]), "none": (kids.limit(0), ["id"])}, 1).collect()
    assert len(r) == 1 and [x.text for x in r[0].notes] == ["x", "y"] and r[0].none is None
    assert findings.as_records(df, ["name", "other"]).columns == ["name"]
    assert [x.project_id for x in findings.new_rows(df, df.where("project_id = 1"), "project_id").collect()] == [2]


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in H.UNREAD

    def handle_endtag(self, tag):
        self.skip -= tag in H.UNREAD

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_main_text_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.t for r in pages.select("page_id", H.main_text(F.col("html")).alias("t")).collect()}
    whole = {r.page_id: r.t for r in pages.select("page_id", H.visible(H.cleaned(F.col("html"))).alias("t")).collect()}
    bare = lambda s: "".join(s.split()).strip(":：;；,，")
    for r in pages.collect():
        p = Text()
        p.feed(r.html)
        assert bare(whole[r.page_id]) == bare("".join(p.out)), r.page_id
        q = Text()
        start = r.html.find("<article")
        q.feed(r.html[start : r.html.find("</article>")] if start >= 0 else r.html)
        assert bare(got[r.page_id]) == bare("".join(q.out)), r.page_id


@pytest.mark.parametrize(
    ("html", "title", "text"),
    [
        ("<title>站点</title><h1>首页</h1><div class='article-title'>甲 公告</div><div class=\"content\"><p>一</p><p>二</p></div>", "甲 公告", "一\n二"),
        ("<title>T</title><p>a&nbsp;&amp;b &amp;lt; &#233;&#x4E2D;&#0;&copy;</p><script>x()</script>", "T", "T\na &b &lt; é中&#0;©"),
        ("", "", ""), (None, "", ""),
    ],
)
def test_pages(spark, html, title, text):
    page = F.lit(html).cast("string")
    assert one(spark, H.page_title(page)) == title
    assert one(spark, F.regexp_replace(H.main_text(page), "^T(?=a)", "T\n")) == text


def test_titles_read_all_entities(spark):
    """Also those in the headings of the driver's pages, which a separator at the end must not cut."""
    title = lambda h: one(spark, H.page_title(F.lit(h)))
    assert title("<h1>token = &quot;2abc3ff2&quot;</h1>") == 'token = "2abc3ff2"' and title("<h1>a &amp;quot; b;</h1>") == "a &quot; b"


def test_json_lines(spark):
    got = lambda s: one(spark, H.json_lines(F.lit(s).cast("string")))
    assert got('{"a": {"b": [1, {"c": null}]}, "d": true}') == ["a.b[0]: 1", "a.b[1].c: null", "d: true"]
    assert got("[1, [2]]") == ["[0]: 1", "[1][0]: 2"] and got("{broken") is None and got(None) is None


def test_error_rules(spark):
    reason = lambda m, s=None, g=None, a=None: one(spark, runs.health_reason(F.lit(m), F.lit(s).cast("int"), F.lit(g).cast("string"), F.lit(a).cast("string")))
    assert [reason("x", g="HTTP_412"), reason("Captcha"), reason("x", a="LOGIN_REQUIRED"), reason("x", 429), reason("rate limit", 500), reason("x", 500), reason("bad JSON"), reason("?")] == ["HTTP_412", "CAPTCHA", "LOGIN_REQUIRED", "RATE_LIMITED", "RATE_LIMITED", "HTTP_ERROR", "PARSER_ERROR", "HTTP_ERROR"]
    assert one(spark, runs.provider_action(F.lit("Session expired"), F.lit(None).cast("int"))) == "LOGIN_REQUIRED" and one(spark, runs.provider_action(F.lit("x"), F.lit(200))) is None
