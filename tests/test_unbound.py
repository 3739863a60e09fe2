"""Operators that no bound query runs, each against what it should return."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions.rules import STRONG, WEAK
from tidemark.operators import concepts, findings, metrics, recall, runs
from tidemark.sources import files
from tidemark.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_overrides_are_evidence(spark):
    evidence = spark.createDataFrame([(1, "bid_deadline", WEAK, "u")], f"project_id int, field_name string, strength {'int' if isinstance(WEAK, int) else 'string'}, url string")
    overrides = spark.createDataFrame([(1, "open_time", "x", True), (2, "open_time", None, True), (3, "open_time", "x", False)], "project_id int, field_name string, manual_value string, active boolean")
    assert rows(recall.evidence_with_overrides(evidence, overrides), "project_id", "field_name", "strength") == sorted([(1, "bid_deadline", WEAK), (1, "open_time", STRONG)], key=repr)


def test_orders_are_total(spark):
    made = [(i, random.Random(i).choice([None, 0.5, 0.7]), None if i % 3 == 0 else dt.datetime(2026, 1, 1 + i % 4)) for i in range(40)]
    pool = spark.createDataFrame(made, "candidate_id int, rank_score double, updated_at timestamp_ntz").repartition(4)
    want = [r[0] for r in sorted(made, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, -(r[2] or dt.datetime(2026, 1, 1)).timestamp(), r[0]))]
    assert [r.candidate_id for r in pool.orderBy(*recall.pool_order()).collect()] == want
    tasks = spark.createDataFrame([(i, "UNKNOWN" if i % 2 else "OPEN", ["r"] if i % 3 else [], dt.datetime(2026, 1, 1 + i % 5)) for i in range(30)], "project_id int, status string, reasons array<string>, updated_at timestamp_ntz")
    next_ = [r.project_id for r in runs.verification_order(tasks, 4).collect()]
    assert next_ == sorted((i for i in range(30) if i % 2 and i % 3), key=lambda i: (-(i % 5), i))[:4]


def test_shares_and_levels(spark):
    df = spark.createDataFrame([("x", "", None, "y")], "a string, b string, c string, d string")
    assert df.select(metrics.key_fields_share([F.col(c) for c in "abcd"]).alias("s")).first().s == 50.0
    given = spark.createDataFrame([("b", "https://x.com"), (None, "https://a.gov.cn/1"), ("Z", "https://mp.weixin.qq.com/s"), (None, "https://x.com")], "given string, url string")
    assert [r[0] for r in given.select(findings.configured_level(F.col("given"), F.col("url"), F.lit("nothing"))).collect()] == ["B", "A", "B", "E"]
    kinds = spark.createDataFrame([("national",), ("regional",), ("enterprise",), ("media",), (None,)], "c string")
    assert [r[0] for r in kinds.select(findings.category_level(F.col("c"))).collect()] == ["A", "A", "B", "D", "D"]


def test_terms_of_a_crawl(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["c", "d"], ["b"]), (["a"], [], ["a"])], "k array<string>, i array<string>, x array<string>")
    got = [r[0] for r in row.select(concepts.crawl_terms(F.col("k"), F.col("i"), F.col("x"))).collect()]
    assert got == [["a", "c", "d"][: concepts.CRAWL_TERMS], list(concepts.DEFAULT_TERMS)]


def test_verification_and_rotation(spark):
    results = spark.createDataFrame([(1, "u", "b"), (1, "u", "a"), (2, "v", "c")], "project_id int, url string, title string")
    assert rows(runs.verification_evidence(results), "project_id", "normalized_value", "raw_value", "confidence") == [(1, "u", "a", 0.5), (2, "v", "c", 0.5)]
    df = spark.createDataFrame([(c,) for c in "abcde"], "c string")
    for day in (0, 2, 7):
        turned = {r.c: r.place for r in runs.rotation(df, "c", day).collect()}
        assert turned == {c: (i - day) % 5 for i, c in enumerate("abcde")}


def test_snapshots_and_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("u1", b"same", 2), ("u2", b"same", 1), ("u3", b"other", 3)], "url string, body binary, at int")
    assert rows(files.snapshots(pages, "body", "at"), "url", "at") == [("u2", 1), ("u3", 3)]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    first = files.write_version(df, f"{tmp_path}/t", 1)
    files.write_version(df.limit(1), f"{tmp_path}/t", 2)
    assert spark.read.parquet(first).count() == 2 and spark.read.parquet(f"{tmp_path}/t").where("v = 2").count() <= 2
    files.write_session(df, f"{tmp_path}/s")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/s").collect()) == ['{"k":1,"v":"a"}', '{"k":2}']
    files.write_report(df, f"{tmp_path}/r", ["v", "k"])
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/r"), "v", "k") == [("a", "1"), (None, "2")]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    made = [("a", dt.datetime(2026, 1, 1, 5)), ("a", dt.datetime(2026, 1, 1, 9)), ("b", dt.datetime(2026, 1, 2, 1)), ("a", dt.datetime(2026, 1, 9))]
    spark.createDataFrame(made, "source string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = incremental.landed(spark, f"{tmp_path}/in", "source string, ts timestamp")
    query = incremental.run_available(incremental.windowed_counts(stream, "ts", "source"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    got = {(r.source, r["items"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 2), ("b", 1)}  # the last window isn't closed yet


def test_evidence_of_merged_notices(spark):
    base = spark.createDataFrame([(1, "owner", "a"), (2, "owner", "b")], "notice_id int, field_name string, value string")
    more = spark.createDataFrame([(1, "agency", "c", 10), (3, "agency", "d", 11)], "notice_id int, field_name string, value string, document_id int")
    assert rows(runs.merged_evidence(base, more), "notice_id", "field_name", "document_id") == sorted([(1, "owner", None), (2, "owner", None), (1, "agency", 10)], key=repr)
    both = spark.createDataFrame([(["x", "y"], ["y", "z"]), (None, ["z"])], "a array<string>, b array<string>")
    assert [r[0] for r in both.select(runs.merged_reasons(F.col("a"), F.col("b"))).collect()] == [["x", "y", "z"], ["z"]]
