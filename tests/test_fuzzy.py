"""Fuzzy name pairs against the ratio of every pair."""

import random

import pytest

from tidemark.operators import core


def ratio(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        prev = row
    return 200.0 * prev[-1] / (len(a) + len(b))


def made_names():
    rng = random.Random(4)
    parts = [[f"{c} {p}" for c in ("blue", "large", "old", "red", "cold", "new") for p in ("anvil", "bolt", "rod")], ["甲县光伏项目", "乙县光伏项目", "某甲县光伏项目", "𠀀县光伏", "𠀁县光伏"]]
    noise = ["".join(rng.choice("aab😀c") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    return [*parts[0], *parts[1], *noise, "", None]


@pytest.mark.parametrize("threshold", [50.0, 70.0, 85.0, 100.0])
def test_all_pairs_are_found(spark, threshold):
    names = made_names()
    norm = sorted({(n or "").replace(" ", "") for n in names} - {""})
    want = {(a, b) for a in norm for b in norm if a < b and ratio(a, b) >= threshold}
    got = [(r.a, r.b) for r in core.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n", threshold).collect()]
    assert sorted(got) == sorted(want)
    assert threshold > 85 or any(a[:2] != b[:2] for a, b in want)


@pytest.mark.parametrize("hot", [0, 3])
@pytest.mark.parametrize("threshold", [55.0, 85.0, 95.0])
def test_hot_segments_lose_nothing(spark, monkeypatch, hot, threshold):
    """Names that share most of their text, so nearly every segment is hot."""
    monkeypatch.setattr(core, "HOT", hot)
    rng = random.Random(int(threshold))
    names = {"".join(rng.choice(["甲", "乙", "丙x", "丁县", "sun", ""]) for _ in range(3)) + "光伏发电项目" + rng.choice(["一期", "二期", "", "EPC总承包"]) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(90)}
    norm = sorted({n.lower() for n in names})
    want = {(a, b) for a in norm for b in norm if a < b and ratio(a, b) >= threshold}
    got = core.fuzzy_pairs(spark.createDataFrame([(n,) for n in norm], "n string"), "n", threshold).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want) and want
    assert all(abs(r.ratio - ratio(r.a, r.b)) < 1e-9 for r in got)


def test_long_names_and_growth(spark, monkeypatch):
    monkeypatch.setattr(core, "HOT", 4)
    rng = random.Random(9)
    syllables = [c + v for c in "bcdfghjklmnpqrstvwxz" for v in "aeiou"]
    long = "".join(rng.choice(syllables) for _ in range(50))
    df = spark.createDataFrame([(long,), (long[:40] + long[44:],), (long[:70],), ("short",)], "n string")
    assert [(r.a, r.b) for r in core.fuzzy_pairs(df, "n", 85.0).collect()] == [tuple(sorted((long, long[:40] + long[44:])))]
    met = []
    for n in (1500, 6000):
        made = spark.createDataFrame([("".join(rng.choice(syllables) for _ in range(8)),) for _ in range(n)], "n string").distinct()
        met.append(core._shared_segments(made, 85.0).count())
    assert met[1] < 0.015 * 6000 * 5999 / 2 and met[1] < 12 * met[0]  # all pairs grow sixteenfold
