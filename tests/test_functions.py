"""Column functions and rules against literal expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, text

NOW = dt.datetime(2026, 8, 28, 12, 0)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("2026-09-05", (2026, 9, 5, 17, 0)), ("2026-09-05 17:00", (2026, 9, 5, 17, 0)), ("2026年9月5日17点", (2026, 9, 5, 17, 0)), ("2026年9月5日17点30分", (2026, 9, 5, 17, 30)),
        ("2026年9月5日 下午5点", (2026, 9, 5, 17, 0)), ("2026年9月5日 上午9点", (2026, 9, 5, 9, 0)), ("2026年9月5日 24:00", (2026, 9, 6, 0, 0)), ("2026/09/05 17:00", (2026, 9, 5, 17, 0)),
        ("2026-09-05T09:00:00+00:00", (2026, 9, 5, 17, 0)), ("DATE 2026-09-05", (2026, 9, 5, 17, 0)), ("9月5日下午5时", (2026, 9, 5, 17, 0)), ("2026-13-45", None), ("", None), (None, None),
    ],
)
def test_dates(spark, given, want):
    got = one(spark, lambda c: text.parse_datetime(c, 2026), given)
    assert got == (dt.datetime(*want) if want else None)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("http://Example.com//a/?utm_source=x&page=2#top", "https://example.com/a"), ("https://a.cn/x?b=2&a=1&a=", "https://a.cn/x?a=&a=1&b=2"), ("http://localhost:8080/a/", "http://localhost:8080/a"),
        ("https://a.cn:443", "https://a.cn/"), ("http://a.cn:80/x", "https://a.cn:80/x"), ("https://u:p@a.cn/x?ref=1", "https://a.cn/x"), ("notes", "notes"), (None, ""), ("  ", ""),
    ],
)
def test_canonical_urls(spark, given, want):
    assert one(spark, text.canonicalize_url, given) == want


def test_text_functions(spark):
    assert one(spark, text.normalize_identity, " 项目-（一）　 ") == "项目一"
    assert one(spark, text.collapse, " a\n 　b ") == "a b"
    assert one(spark, text.domain, "HTTP://www.A.cn:81/x") == "a.cn"
    assert [float(one(spark, text.money, v) or 0) for v in ("1,200.5万元", "3亿元", "100元", "100万", "88")] == [12005000.0, 3e8, 100.0, 0.0, 88.0]
    assert one(spark, text.capacity_mw, "当雄800MW光伏+0.1GW光热, 300MWh储能, 5000kW") == 800.0
    pairs = [("abcbdab", "bdcaba", 4), ("新疆某地集中式光伏发电项目", "新疆某地集中式光伏发电项目招标公告", 13), ("", "a", 0), ("同", "同", 1)]
    got = spark.createDataFrame(pairs, "a string, b string, n int").select("a", "b", "n", text.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == pytest.approx(200 * r.n / max(1, len(r.a) + len(r.b))) for r in got)
    assert one(spark, lambda c: F.array_join(text.matched_terms(c, ["EPC", "光伏", "epc", "风"]), ","), "光伏epc") == "EPC,光伏,epc"


FIELDS = ", ".join(f"{f} timestamp_ntz" for f in rules.TIME_FIELDS)


@pytest.mark.parametrize(
    ("fields", "marker", "want"),
    [
        ({"registration_start": (8, 27, 9), "registration_deadline": (9, 1, 17), "bid_deadline": (9, 10, 17)}, False, "OPEN_REGISTRATION_ACTIVE"),
        ({"document_start": (8, 28, 9), "document_deadline": (9, 1, 17), "bid_deadline": (9, 10, 17)}, False, "OPEN_DOCUMENT_DOWNLOAD_ACTIVE"),
        ({"registration_start": (8, 20, 9), "registration_deadline": (8, 27, 17), "bid_deadline": (9, 10, 17), "open_time": (9, 10, 9)}, False, "CLOSED_REGISTRATION_EXPIRED"),
        ({"qualification_deadline": (8, 27, 17), "bid_deadline": (9, 10, 17)}, False, "CLOSED_QUALIFICATION_EXPIRED"),
        ({"document_deadline": (8, 27, 17), "bid_deadline": (9, 10, 17)}, False, "CLOSED_DOCUMENT_DEADLINE_EXPIRED"),
        ({"open_time": (8, 27, 17)}, False, "CLOSED_OPENED"),
        ({"bid_deadline": (9, 10, 17), "open_time": (9, 11, 9)}, False, "UNKNOWN_NO_PARTICIPATION_DEADLINE"),
        ({"registration_start": (9, 1, 9), "registration_deadline": (9, 10, 17), "bid_deadline": (9, 20, 17)}, False, "UNKNOWN_SOURCE_INCOMPLETE"),
        ({"registration_deadline": (8, 28, 12)}, False, "CLOSED_REGISTRATION_EXPIRED"),
        ({"bid_deadline": (9, 10, 17), "open_time": (9, 11, 9)}, True, "OPEN_PARTICIPATION_ACTIVE"),
        ({"document_start": (9, 5, 0), "document_deadline": (8, 20, 0)}, False, "UNKNOWN_CONFLICTING_DATES"),
        ({"registration_deadline": (9, 10, 17)}, False, "UNKNOWN_NO_BID_DEADLINE"),
        ({}, False, "UNKNOWN_NO_PARTICIPATION_DEADLINE"),
    ],
)
def test_status(spark, fields, marker, want):
    row = [dt.datetime(2026, *fields[f]) if f in fields else None for f in rules.TIME_FIELDS]
    reason = rules.status_reason(F.lit(NOW).cast("timestamp_ntz"), F.lit(False), F.lit(marker))
    assert spark.createDataFrame([row], FIELDS).select(reason.alias("r")).first().r == want


def test_rules(spark):
    assert one(spark, rules.relevance, "哈密光伏支架采购招标公告") == "DIRECT"
    assert one(spark, rules.relevance, "光伏项目EPC总承包") == "EMBEDDED"
    assert one(spark, rules.relevance, "光伏车棚") == "STRUCTURAL_RELATED"
    assert one(spark, rules.relevance, "天气") == "IRRELEVANT"
    strength = lambda k, t, p: spark.range(1).select(rules.evidence_strength(F.lit(k), F.lit(t), F.lit(p)).alias("r")).first().r
    assert [strength("INFERRED", "t", "p"), strength("DIRECT_TEXT", None, None), strength("other", "t", "p"), strength("other", "t", None)] == [1, 2, 2, 0]
    assert one(spark, lambda c: rules.response_action(F.lit(412), c), "") == "VERIFICATION_REQUIRED"
    assert one(spark, lambda c: rules.result_mode(F.lit(None).cast("string"), c), "给我完整结果") == "FULL"
    assert [one(spark, rules.completeness_state, v, "int") for v in (90, 60, 59, 3)] == ["COMPLETE", "USABLE", "PARTIAL", "LEAD_ONLY"]


def test_notice_helpers(spark):
    assert [one(spark, text.change_type, v) for v in ("延期公告", "变更公告", "招标公告", None)] == ["extension", "change", "original", "original"]
    assert [one(spark, text.time_precision, v) for v in ("截至2026年9月5日", "9月1日至9月5日", "2026-09-05 17:00")] == ["DATE_ONLY", "RANGE", "DATETIME"]
    low, high = spark.range(1).select(*text.day_bounds(F.lit(NOW).cast("timestamp_ntz"))).first()
    assert (low, high) == (dt.datetime(2026, 8, 28), dt.datetime(2026, 8, 28, 23, 59, 59, 999999))
    pages = spark.createDataFrame([([(1, "a b"), (2, "招 标\n公告")],)], "v array<struct<page_number:int,text:string>>")
    assert pages.select(text.page_for(F.col("v"), F.lit("招标 公告")).alias("r"), text.page_for(F.col("v"), F.lit("q")).alias("n")).first()[:] == (2, None)
    assert one(spark, lambda c: F.array_join(text.missing_fields({"a": c, "b": F.lit(1), "c": F.lit(" ")}), ","), None) == "a,c"
    assert [one(spark, text.http_status_note, v) for v in ("seen HTTP 412 twice", "none")] == [412, None]
