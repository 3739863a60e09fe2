"""Commits of several tables, and the full-text index built on them."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext
from tidemark.sources.store import Change, Conflict, Store, new_folder


@pytest.fixture
def store(spark):
    return Store(spark, new_folder(spark, "store"))


def rows(snapshot, name):
    return sorted(tuple(r) for r in snapshot.table(name).collect())


def test_upsert_append_delete_replace(spark, store):
    a = lambda x: spark.createDataFrame(x, "k int, v string")
    one = store.commit(store.snapshot(), [Change("t", a([(1, "a"), (2, "b"), (None, "n")]), ("k",)), Change("log", a([(1, "x")]), ("k",), "append")])
    two = store.commit(one, [Change("t", a([(2, "c"), (3, "d"), (None, "m")]), ("k",)), Change("log", a([(1, "y")]), ("k",), "append")])
    assert sorted(r.v for r in one.table("t").collect()) == ["a", "b", "n"]
    assert sorted(r.v for r in two.table("t").collect()) == ["a", "c", "d", "m"]
    assert rows(two, "log") == [(1, "x"), (1, "y")]
    # untouched buckets keep their files
    assert set(one.tables["t"].files) & set(two.tables["t"].files)
    three = store.commit(two, [Change("t", a([(1, None)]), ("k",), "delete"), Change("log", a([(5, "z")]), ("k",), "replace")])
    assert sorted(r.v for r in three.table("t").collect()) == ["c", "d", "m"] and rows(three, "log") == [(5, "z")]
    assert store.snapshot().version == 3 and rows(store.snapshot(1), "log") == [(1, "x")]


def test_nothing_of_a_failed_commit_is_seen(spark, store):
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    base = store.commit(store.snapshot(), [Change("a", good, ("k",)), Change("b", good, ("k",))])
    broken = good.select("k", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.commit(base, [Change("a", good.withColumn("v", F.lit("new")), ("k",)), Change("b", broken, ("k",))])
    # one table was written, no reader sees it
    assert store.snapshot().version == 1 and rows(store.snapshot(), "a") == [(1, "a")]
    assert any(f.startswith("data/a/") for f in store.unnamed())
    again = store.commit(store.snapshot(), [Change("a", good.withColumn("v", F.lit("new")), ("k",)), Change("b", good, ("k",))])
    assert rows(again, "a") == [(1, "new")]


def test_two_writers(spark, store):
    df = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    base = store.snapshot()
    store.commit(base, [Change("t", df("first"), ("k",))])
    with pytest.raises(Conflict):
        store.commit(base, [Change("t", df("second"), ("k",))])
    after = store.retried(lambda now: ([Change("t", df("second"), ("k",))], lambda made: {"n": made.table("t").count()}))
    assert rows(after, "t") == [(1, "second")] and after.facts["n"] == 1


def test_two_readers(spark, store):
    df = lambda v: spark.createDataFrame([(k, v) for k in range(20)], "k int, v string")
    store.commit(store.snapshot(), [Change("t", df("old"), ("k",)), Change("u", df("old"), ("k",))])
    early = store.snapshot()
    store.commit(early, [Change("t", df("new"), ("k",)), Change("u", df("new"), ("k",))])
    late = Store(spark, store.root).snapshot()
    for reader, v in ((early, "old"), (late, "new")):
        assert {r.v for t in ("t", "u") for r in reader.table(t).collect()} == {v}


def bm25(texts, query, most=50):
    tokens = {k: Counter(t for x in v for t in re.findall(r"[^\W_]+", (x or "").lower())) for k, v in texts.items()}
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    n, mean = len(tokens), sum(sum(c.values()) for c in tokens.values()) / len(tokens)
    out = []
    for k, c in tokens.items():
        if words and all(c[w] for w in words):
            s = 0
            for w in words:
                df = sum(1 for x in tokens.values() if x[w])
                idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
                s += round(1e6 * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)))
            out.append((-s, k))
    return [(i + 1, k, -s / 1e6) for i, (s, k) in enumerate(sorted(out)[:most])]


PROJECTS = [(1, "Solar farm north", "Grid Co"), (2, "solar roof", "Grid Co"), (3, "风电 项目", None), (4, "Wind-farm solar solar", "甲公司"), (5, "", "")]
SAID = [(1, "the farm of the north"), (1, "solar again"), (3, "solar 项目"), (2, None), (9, "not a project")]


def tables(spark, projects, said):
    p = spark.createDataFrame(projects, "project_id int, project_name string, owner string")
    return p, spark.createDataFrame(said, "project_id int, clean_text string")


def whole(projects, said):
    return {k: [name, owner, *[t for p, t in said if p == k]] for k, name, owner in projects}


def ranked(spark, index, *queries):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    found = fulltext.rank(index, q).collect()
    return [sorted((r.place, r.project_id, r.score) for r in found if r.query_id == i) for i in range(len(queries))]


QUERIES = ("solar", "SOLAR farm", "grid co", "项目", "nothing", "", "solar solar")


def test_index_is_ranked_refreshed_and_compacted(spark, store):
    fulltext.refresh(store, *tables(spark, PROJECTS, SAID))
    index = store.snapshot()
    assert ranked(spark, index, *QUERIES) == [bm25(whole(PROJECTS, SAID), q) for q in QUERIES]
    # project 2 changes, 6 is new, 3 goes
    changed, new_said = [(2, "roof of glass", "Solar Co"), (6, "solar solar farm", "x")], [(2, "farm farm")]
    gone = spark.createDataFrame([(3,)], "project_id int")
    after = fulltext.refresh(store, *tables(spark, changed, new_said), removed=gone)
    now = [p for p in PROJECTS if p[0] not in (2, 3)] + changed
    want = [bm25(whole(now, [s for s in SAID if s[0] != 2] + new_said), q) for q in QUERIES]
    assert ranked(spark, after, *QUERIES) == want
    assert ranked(spark, index, "solar")[0] == bm25(whole(PROJECTS, SAID), "solar")
    # only the segment's postings were written
    assert after.table("postings").where("segment = 2").select("project_id").distinct().count() == 2
    assert ranked(spark, fulltext.compacted(store), *QUERIES) == want
    assert store.snapshot().table("postings").select("segment").distinct().count() == 1


def test_search_falls_back_to_a_scan(spark, store):
    p, said = tables(spark, PROJECTS, SAID)
    index = fulltext.refresh(store, p, said)
    found = lambda text, index=index, most=50: [(r.project_id, r.score) for r in fulltext.search(index, p, text, most).orderBy("place").collect()]
    assert [k for k, _ in found("solar farm")] == [k for _, k, _ in bm25(whole(PROJECTS, SAID), "solar farm")]
    assert found("ola") == [(1, None), (2, None), (4, None)]  # no token, but a part of names
    assert found("  ") == [] and found("zzz") == []
    assert found("solar", None) == [(1, None), (2, None), (4, None)]
    assert len(found("solar", most=1)) == 1


def test_empty_index(spark, store):
    index = fulltext.refresh(store, *tables(spark, [], []))
    assert ranked(spark, index, "solar") == [[]]
    assert fulltext.search(index, tables(spark, [], [])[0], "solar").collect() == []
