"""Edge cases that the other tests don't reach: copies of one row, clashing columns, very long texts, files that prune."""

import collections

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, mixing, neighbours, quality, sharding, simhash, token_store, url_filter, warc
from tidemark.llm.common import parts, scratch, words_of, written

LONG = "word and another one, " * 150_000  # 3.3 MB


def test_parts_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (5, 0, None, 30, 5, 5, 5)])], ["t"])
    got = [[len(x or "") for x in p.column(0).to_pylist()] for p in parts([batch, batch.slice(0, 0)], "t", 10)]
    assert got == [[5, 0, 0], [30], [5, 5], [5]]


def test_words_of():
    texts = pa.array([" a  b\ta", None, "", "\x1ca\x85 　é\n", "b"])
    spelled, index, of = words_of(texts)
    words = spelled.to_pylist()
    assert [(words[i].decode(), t) for i, t in zip(index, of, strict=True)] == [("a", 0), ("b", 0), ("a", 0), ("\x1ca\x85", 3), ("　é", 3), ("b", 4)]


@pytest.fixture(scope="module")
def copies(spark):
    """Two thirds of the rows are equal, a sixth equal but for a column beside id and text."""
    rows = [(7, "the same text " * 20, "s", 0, 0)] * 2000 + [(8, "another text " * 20, f"s{i}", 0, 0) for i in range(500)] + [(100 + i, f"text {i} " * 20, "s", 0, 0) for i in range(500)]
    return written(spark.createDataFrame(rows, "doc_id long, text string, source string, cell int, copies int").repartition(6), "copies")


def test_sharding_spreads_copies(spark, copies):
    path = scratch(spark, "s")
    sharding.write_shards(copies, path, bucket_mb=0.02)
    got = sharding.read_shards(spark, path, copies)
    rows = got.collect()
    key = lambda r: (r.doc_id, r.text, r.source, r.cell, r.copies)
    assert collections.Counter(map(key, rows)) == collections.Counter(map(key, copies.collect()))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # copies are in all shards alike
    per_shard = collections.Counter(r.shard for r in rows if r.doc_id == 7)
    assert len(per_shard) == 8 and max(per_shard.values()) < 2 * min(per_shard.values())
    again = scratch(spark, "s")
    sharding.write_shards(copies.repartition(3), again, bucket_mb=0.02)
    order = lambda df: sorted((r.shard, r.slot, *key(r)) for r in df.collect())
    assert order(sharding.read_shards(spark, again, copies)) == order(got)


def test_bucket_plan():
    rng = np.random.default_rng(0)
    cell = np.arange(sharding.CELLS)
    rows = rng.integers(1, 4, sharding.CELLS)
    size = rows * 1000
    size[5] = 90_000_000
    buckets, large = sharding.plan_buckets(cell, size, 16 << 20, 16)
    assert buckets == -(-int(size.sum()) // (16 << 20)) and large.tolist() == [5]
    # a petabyte still has a bounded number of buckets
    huge = np.full(sharding.CELLS, 4 << 30, dtype=np.int64)
    assert sharding.plan_buckets(cell, huge, 16 << 20, 16)[0] <= sharding.CELLS


def test_token_files_are_indexed_and_prune(spark, tmp_path):
    import public_tokenizers as P

    docs = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of document "), "id").alias("text"))
    path = scratch(spark, "t")
    token_store.write_tokens(docs, path, P.path("word_bpe_49k.json"))
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.orc").load(path).select("path").collect()]
    spans = []
    for f in files:
        o = orc.ORCFile(f.removeprefix("file:"))
        ids = o.read(columns=["doc_id"])["doc_id"].to_numpy()
        assert (np.diff(ids) > 0).all() and o.nstripes >= 1
        spans.append((ids.min(), ids.max()))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    # the filter is pushed to the files
    one = spark.read.schema(token_store.STORED).orc(path).where("doc_id = 1234")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1234)]" in plan and one.count() == 1
    assert spark.read.schema(token_store.STORED).orc(path).where("doc_id = 99999").count() == 0


def test_other_tokenizers_are_served_by_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, texts = Tokenizer.from_file(path), ["Some  text,\n\twith é 中文", None, "", "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = scratch(spark, "t")
    token_store.write_tokens(docs, out, path)
    got = {r.doc_id: r.ids for r in token_store.read_tokens(spark, out).collect()}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


def test_stripes_are_read_as_rows_are(spark, copies):
    import public_tokenizers as P

    docs = copies.unionByName(spark.createDataFrame([(None, None, "s", 0, 0), (5, "", "s", 0, 0)], copies.schema))
    path = scratch(spark, "t")
    token_store.write_tokens(docs, path, P.path("word_bpe_49k.json"), stripe_mb=0)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = rows(token_store.stored_checksums(spark, path))
    assert got == rows(token_store.checksums(token_store.read_tokens(spark, path))) and len(got) == 3002
    none = scratch(spark, "t")
    token_store.write_tokens(docs.limit(0), none, P.path("word_bpe_49k.json"))
    assert token_store.stored_checksums(spark, none).count() == 0


def test_clashing_columns(spark):
    extra = {c: F.lit(1) for c in ("component", "rule", "verdict", "node", "host", "path", "inherited", "tags", "base", "link")}
    pages = spark.createDataFrame([(1, "http://net/x", "<p>"), (2, "http://a.com/", '<link rel=canonical href="http://net/x">')], "page_id int, url string, html string").withColumns(extra)
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.RULES).collect()} == {1: "block", 2: "block"}
    records = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "refers_to", "record_type", "digest", "first")})
    path = scratch(spark, "w")
    manifest = warc.normalise(warc.write_monolithic(warc.with_revisits(records), f"{path}/crawl"), f"{path}/archive")
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(manifest).collect()) == [(1, "response"), (2, "revisit")]
    docs = spark.createDataFrame([(i, f"a b c {i % 3}") for i in range(60)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "row", "beyond", "held_out", "logs", "part", "tokens")})
    assert lm.scores(docs).count() == 60
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 30)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("item", "dim", "tree", "block", "part", "slice", "score", "rank", "asks")})
    assert neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").select("vec_id").collect() == [(29,), (28,), (27,)]


def test_doubles_are_scored_as_they_are(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, block_bytes=1024).collect():
        assert r.score == pytest.approx(float(v[r.query_id] @ v[r.vec_id]), abs=1e-13)


def test_neighbours_over_many_blocks(spark):
    """Small blocks, so that prefixes span them: recall holds, ties go to the smaller id."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (3000, 6)).astype(np.float32)
    v[:, 0] += 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, block_bytes=4096).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w, hits = v.astype(np.float64), []
    for q in range(0, 3000, 20):
        s = w @ w[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        have = got[q]
        assert len(have) == 20 and [(-x, i) for i, x in have] == sorted((-x, i) for i, x in have) and all(x == s[i] for i, x in have)
        hits.append(sum(x >= s[want[-1]] for _, x in have) / 20)
    assert np.mean(hits) >= 0.9


def test_very_long_texts(spark):
    docs = written(spark.createDataFrame([(1, LONG), (2, LONG + "end"), (3, "short"), (4, "長い文 " * 400_000)], "doc_id long, text string").withColumn("source", F.lit("s")), "long")
    assert quality.judge(docs, None).where("n_words >= 400000").count() == 3
    assert simhash.near_duplicates(docs).count() == 4
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {1, 3, 4}
    assert lm.scores(docs).where("n_tokens > 400000").count() == 3
    assert mixing.plan_mix(docs).where("size >= 400000").count() == 3
    path = scratch(spark, "s")
    sharding.write_shards(docs, path)
    assert sharding.read_shards(spark, path, docs).where("length(text) > 1000000").count() == 3


def test_shared_folder_is_asked_for_on_clusters():
    from tidemark.llm.common import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://h:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
