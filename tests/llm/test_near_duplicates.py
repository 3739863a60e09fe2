"""The pipeline's near-duplicate stage against the similarity of distinct five-word shingles."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm import simhash
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def shingles(text, width=5):
    w = text.lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def kept_ids(spark, texts):
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    return sorted(r.doc_id for r in kept.collect())


def with_repeats(rng, passage, times, n):
    """``n`` words, of which a passage makes up ``times`` stretches between words of the text's own."""
    own = words(rng, n - times * len(passage))
    step = len(own) // times
    return " ".join(w for i in range(times) for w in own[i * step : (i + 1) * step if i < times - 1 else len(own)] + passage)


def test_a_repeated_passage_makes_no_duplicates(spark):
    rng = random.Random(5)
    texts = []
    for times, length, n in [(20, 14, 1000), (25, 20, 2000)] * 6:
        passage = words(rng, length)
        texts += [with_repeats(rng, passage, times, n) for _ in range(2)]
    assert all(jaccard(texts[i], texts[i + 1]) < 0.02 for i in range(0, len(texts), 2))
    assert kept_ids(spark, texts) == list(range(len(texts)))


def test_repeats_do_not_hide_duplicates(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(8):
        own, passage = words(rng, 300), words(rng, 10)
        texts += [" ".join(own + passage * k) for k in (1, 30)]
    assert all(jaccard(texts[i], texts[i + 1]) >= 0.95 for i in range(0, len(texts), 2))
    assert kept_ids(spark, texts) == list(range(0, len(texts), 2))


def groups_by_brute_force(texts):
    """The least position of each text's group, over all pairs at 0.8 or more."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def planted(rng, similarity, n=200):
    """Two texts of ``n`` shingles, the second with its tail replaced, so that they are similar by about ``similarity``."""
    common = round(2 * n * similarity / (1 + similarity))
    own = words(rng, n + 4)
    return " ".join(own), " ".join(own[: common + 4] + words(rng, n - common))


def many(rng):
    texts = []
    for similarity in [0.6, 0.65, 0.7, 0.75, 0.78, 0.79, 0.8, 0.81, 0.85, 0.9] * 8:
        texts += planted(rng, similarity)
    # a chain, each similar to the next only
    own = words(rng, 260)
    texts += [" ".join(own[k : k + 200]) for k in range(0, 60, 15)]
    # short texts, where a shingle more or less counts
    own = words(rng, 40)
    return [*texts, *[" ".join(own[:k]) for k in range(6, 41)], "", "  ", "one", "one two", "One Two"]


def test_links_are_those_of_brute_force(spark):
    texts = many(random.Random(7))
    want = sorted(set(groups_by_brute_force(texts)))
    assert 100 < len(want) < len(texts) - 30
    assert kept_ids(spark, texts) == want


def test_similar_links_over_parts(spark):
    rng = random.Random(8)
    texts = many(rng)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    prints = simhash.fingerprints(docs.select("doc_id", "text"), 5, simhash.WIDE_WORDS, sized=True).collect()
    rows = [(r.doc_id.to_bytes(4, "big"), bytes(r.node), b"all", texts[r.doc_id]) for r in prints]
    sets = simhash.shingle_sets(spark.createDataFrame(rows, "key binary, node binary, cluster binary, text string"), 5)
    from tidemark.llm.components import components

    links = simhash.similar_links(sets, simhash.WIDE_RADIUS, simhash.WIDE_RATIO, part=40_000)
    found = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in components(links, "a", "b").collect()}
    want = groups_by_brute_force(texts)
    assert [found.get(i, i) for i in range(len(texts)) if texts[i].strip()] == [want[i] for i in range(len(texts)) if texts[i].strip()]


@pytest.mark.skipif(not Path(SF).exists(), reason="the test data isn't here")
def test_the_stage_over_what_quality_keeps(spark):
    (_, good), (_, near) = corpus_pipeline.STAGES[:2]
    docs = written(good(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "good")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    # more near copies than the data have, of its own texts: about 0.7, 0.8, 0.9, and a passage repeated
    rng, more = random.Random(9), []
    for k, (_, text) in enumerate(rows[:60]):
        own = text.split()
        n = max(1, len(own) * (10, 20, 30)[k % 3] // 200)
        more.append(" ".join(own[: len(own) - n] + words(rng, n)) if k % 4 else text + " " + " ".join(own[:14] * 3))
    top = rows[-1][0] + 1
    extra = spark.createDataFrame([(top + i, x) for i, x in enumerate(more)], SCHEMA)
    out = near(spark, docs.select("doc_id", "text").unionByName(extra), SF)
    texts = [t for _, t in rows] + more
    ids = [i for i, _ in rows] + [top + i for i in range(len(more))]
    want = sorted(ids[k] for k in set(groups_by_brute_force(texts)))
    assert sorted(r.doc_id for r in out.collect()) == want
    assert 0 < len(texts) - len(want) < len(more), (len(rows), len(texts), len(want))
