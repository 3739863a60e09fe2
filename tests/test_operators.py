"""Operators on small literal tables."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.operators import core
from tidemark.sources import files
from tidemark.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_latest_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None, 9, "n"), (1, 5, 1, "a"), (1, 5, 2, "b"), (2, None, 1, "c")], "p int, at int, id int, t string")
    assert rows(core.latest_per_key(df, ["p"], ["at", "id"], ["t"])) == [(1, "b"), (2, "c")]


def test_late_announcements_recall_old_projects(spark):
    t = dt.datetime
    projects = spark.createDataFrame([(1, t(2026, 5, 1)), (2, t(2026, 5, 1)), (3, None)], "project_id int, publish_time timestamp_ntz")
    notes = spark.createDataFrame([(1, t(2026, 8, 26)), (2, t(2026, 5, 2)), (9, t(2026, 8, 26))], "project_id int, published_at timestamp_ntz")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (t(2026, 8, 1), t(2026, 8, 31)))
    assert [r[0] for r in rows(core.in_window(projects, notes, low, high))] == [1, 3]


def test_upsert_is_idempotent_and_null_safe(spark):
    old = spark.createDataFrame([(1, None, "x", None), (2, "u", "y", 7)], "p int, url string, text string, page int")
    new = spark.createDataFrame([(1, None, "x", 4), (2, "u", "y", 9), (3, None, "z", 1), (3, None, "z", 1)], old.schema)
    once = core.upsert_evidence(old, new, ["p", "url", "text"], ["page"])
    assert rows(once) == [(1, None, "x", 4, 0), (2, "u", "y", 7, 0), (3, None, "z", 1, 1)]
    assert rows(core.upsert_evidence(once.drop("inserted"), new, ["p", "url", "text"], ["page"]).drop("inserted")) == rows(once.drop("inserted"))


def test_fuzzy_pairs_against_brute_force(spark):
    names = ["alpha beta", "alpha betas", "alpha gamma", "al", "beta", "alphabeta!", "", None]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    norm = sorted({"".join((n or "").split()) for n in names} - {""})
    want = {(a, b) for a in norm for b in norm if a < b and a[:2] == b[:2] and 200 * lcs(a, b) / (len(a) + len(b)) >= 70}
    got = core.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n", threshold=70.0).collect()
    assert {(r.a, r.b) for r in got} == want and want


def test_codes_suppression_conflicts_counts(spark):
    codes = spark.createDataFrame([(3, "P-001"), (1, "p001"), (2, None), (4, " ")], "id int, code string")
    assert rows(core.code_groups(codes, "id", F.col("code"))) == [(1, 1), (2, 2), (3, 1), (4, 4)]
    live = spark.createDataFrame([(1, 5), (2, 1), (3, 0)], "k int, changed_at int")
    reports = spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "k int, reported_at int")
    assert [r.k for r in core.unchanged_suppressed(live, reports, "k", F.col("changed_at") > F.col("reported_at")).orderBy("k").collect()] == [1, 3]
    values = spark.createDataFrame([(1, "a"), (1, " a "), (1, "b"), (2, "x"), (2, None)], "p int, v string")
    assert rows(core.conflicts(values, ["p"], "v")) == [(1, 2, "a|b")]
    assert rows(core.zero_filled_counts(values.select(F.col("v").alias("layer")), "layer", ["a", "q"])) == [("a", 1), ("q", 0)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("中文".encode("gb18030"))
    (tmp_path / "b.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("docs/notice.html", "../outside.html", "notes.exe"):
            z.writestr(name, "x")
    docs = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.documents(spark, f"file://{tmp_path}").collect()}
    assert docs["a.html"] == ("中文", None) and docs["b.bin"] == (None, "UNSUPPORTED_TYPE")
    assert [r.member for r in files.zip_members(spark, f"file://{tmp_path}").collect()] == ["docs/notice.html"]
    answers = [(1, json.dumps({"data": {"records": [{"id": "a"}, {"id": "b"}]}})), (2, json.dumps([{"id": "c"}])), (3, "{broken")]
    got = files.json_listing(spark.createDataFrame(answers, "page int, body string"), "body", "id string")
    assert rows(got) == [(1, "a"), (1, "b"), (2, "c")]
    html = spark.createDataFrame([(1, "<a href='f.pdf'>A<b>1</b></a><a href=\"f.pdf\">Z</a><a href='x.htm'>n</a>")], "id int, html string")
    assert rows(files.attachment_links(html, "id", "html")) == [(1, "f.pdf", "Z")]
    found = spark.createDataFrame([("q", "a", 1, True, "u0"), ("q", "b", 2, False, None), ("q", "c", 3, False, "u1")], "q string, p string, rank int, failed boolean, url string")
    assert files.provider_fallback(found, "q", "p", "rank", "failed").count() == 0


def test_stream_keeps_the_first_of_each_url(spark, tmp_path):
    t = dt.datetime(2026, 8, 1)
    spark.createDataFrame([("http://a.cn/x?utm_a=1", t), ("https://a.cn/x#y", t), ("http://b.cn", t)], "url string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.landed(spark, f"{tmp_path}/in", "url string, ts timestamp")
    incremental.run_available(incremental.first_seen_urls(stream, "url", "ts"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    assert sorted(r.canonical_url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["https://a.cn/x", "https://b.cn/"]
