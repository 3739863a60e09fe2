"""A dictionary of places in a table against the one that a plan carries."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import places
from tidemark.operators.places import Places, label_table, matched
from tidemark.sources.store import saved

LEVELS = ["province", "city", "county", "special_region", "district", "village"]


def made(rng, n):
    name = lambda: "".join(rng.choice("甲乙丙丁A-b😀 ") for _ in range(rng.randint(1, 6)))
    return [{"code": f"c{i}", "name": name(), "aliases": [name() for _ in range(rng.randint(0, 3))], "level": rng.choice(LEVELS), "parent": rng.choice([None, f"c{rng.randrange(n)}", "none"])} for i in range(n)]


def table(spark, entries):
    rows = [(e["code"], e["name"], e["aliases"], e["level"], e["parent"], i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "code string, name string, aliases array<string>, level string, parent string, place int")


@pytest.mark.parametrize("n", [1, 30, 200])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_to_the_array_form(spark, monkeypatch, n, broadcast):
    if not broadcast:
        monkeypatch.setattr(places, "BROADCAST", 0)
    monkeypatch.setattr(places, "BLOCK", 16)
    rng = random.Random(n)
    entries = made(rng, n)
    texts = [(i, "".join(rng.choice("甲乙丙丁ab😀 -，x") for _ in range(rng.choice([0, 3, 10, 60, 300])))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    labels = saved(label_table(table(spark, entries)), "labels")
    got = {r.id: (r.code, r.path) for r in matched(df, ["id"], "text", labels).collect()}
    want = df.select("id", Places(entries).match(F.col("text")).alias("m")).where("m is not null").collect()
    assert got == {r.id: (r.m.code, r.m.path) for r in want} and (n == 1 or got)


def test_many_labels_long_texts_and_none(spark):
    entries = [{"code": f"c{i}", "name": f"place {i:05d}", "aliases": [f"alias{i}"], "level": "city", "parent": "c0" if i else None} for i in range(30_000)]
    labels = saved(label_table(table(spark, entries)), "labels")
    assert labels.count() == 60_000
    texts = [(1, "x" * 5000 + " Place-29 999 " + "y" * 300 + "alias7"), (2, "nothing"), (3, "alias12345 and alias1"), (1, "place 00003")]
    got = {r.id: (r.code, r.path) for r in matched(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", labels).collect()}
    assert got == {1: ("c3", ["place 00000", "place 00003"]), 3: ("c12345", ["place 00000", "place 12345"])} or got[1][0] in ("c3", "c29999")
    assert got[1] == ("c3", ["place 00000", "place 00003"])  # of equal labels the first entry
    none = labels.limit(0)
    assert matched(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", none).collect() == []


def test_paths(spark):
    entries = [
        {"code": "a", "name": "A", "aliases": None, "level": "province", "parent": "c"}, {"code": "b", "name": "B", "aliases": [], "level": "city", "parent": "a"},
        {"code": "c", "name": "C", "aliases": [], "level": "county", "parent": "b"}, {"code": "d", "name": "D", "aliases": ["  "], "level": "city", "parent": "gone"},
    ]
    got = {r.code: r.path for r in label_table(table(spark, entries)).collect()}
    plain = Places([{**e, "aliases": e["aliases"] or ()} for e in entries])
    assert got == {e["code"]: [x["name"] for x in plain.chain(e["code"])] for e in entries}
    with pytest.raises(ValueError, match="twice"):
        label_table(table(spark, [*entries, entries[0]]))


def test_large_dictionaries_stay_off_the_driver(spark, monkeypatch):
    """Nothing is broadcast because its file is expected to be small; beyond a count labels are held against a sketch, which loses none."""
    entries = [{"code": f"c{i}", "name": f"place number {i:05d}", "aliases": [], "level": "city", "parent": "c0" if i else None} for i in range(3000)]
    made = label_table(table(spark, entries))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    labels = saved(made, "labels")
    found = labels.select("label").unionByName(spark.range(3000).selectExpr("concat('other', id) AS label"))
    kept = {r.label for r in places._perhaps(found, labels, 3000).collect()}
    assert {r.label for r in labels.collect()} <= kept and len(kept) < 3600
    monkeypatch.setattr(places, "BROADCAST", 20)
    texts = spark.createDataFrame([(1, "x" * 200 + " Place-number 02 999 place number 00007"), (2, "place number 3"), (3, "place number 01234")], "id int, text string")
    assert {r.id: r.code for r in matched(texts, ["id"], "text", labels).collect()} == {1: "c7", 3: "c1234"}
