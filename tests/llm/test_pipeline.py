"""The pipeline's stages against plain versions over the smallest data."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_registered import WORD, plain_features

import corpus_pipeline
from tidemark.llm import mixing, quality, simhash
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test data isn't here")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, seen, SF), "stage")
        assert out.columns == columns, name
        if "quality" in name:
            model = quality.trained(seen, spark.read.parquet(f"{SF}/labels.parquet"))
            assert out.count() == quality.judge(seen, model).where("kept").count() < seen.count()
        elif "SimHash" in name:
            assert out.join(seen, "doc_id", "left_anti").count() == 0
            # a document of each group of equal texts stays
            assert out.groupBy("text").count().where("count > 1").count() == 0
            assert simhash.drop_near_duplicates(out).count() == out.count()
        else:
            assert out.count() == mixing.plan_mix(seen).agg(F.sum("copies")).first()[0]
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    held = seen.select("doc_id", F.sha2("text", 256).alias("sha"))
    assert last.select("doc_id", "decoded_sha256").exceptAll(held).count() == 0 and last.count() == seen.count()


def test_run_over_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ("mixed_source", "size", "source_size", "target", "rate", "copies", "copy", "row", "of", "drawn", "kept", "probability", "n_words", "r", "node", "group")


def test_clashing_names_and_odd_rows_go_through(spark):
    """Null, empty, very long, tied and repeated rows, null ids and sources, and columns named like those of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(60_000))
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (None, "a b " * 30, None, None, None), (900_003, long, "en", None, 1), (900_004, long, "en", "s", 1), (900_004, long, "en", "s", 1)], docs.schema)
    seen = docs.unionByName(odd).select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, seen, SF), "stage")
        assert out.columns == seen.columns, name
        wrong = [F.col(c) != F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING]
        assert not any(out.where(w).count() for w in wrong), name
        if "SimHash" in name:
            assert out.where("doc_id >= 900003").count() <= 1
        seen = out
    assert seen.where("text is null or text = ''").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, seen, SF).count() == seen.count()


def test_quality_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        repeated = len({j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)})
        score = model.bias + sum(np.mean(model.weights[k][f]) for k, f in enumerate(plain_features(r.text or "")) if f)
        p = 1 / (1 + math.exp(-max(-50, min(50, model.slope * score + model.offset))))
        kept = len(w) >= 20 and 100 * repeated <= 30 * len(w) and p >= 0.5
        assert (r.doc_id in got) == kept or abs(p - 0.5) < 1e-5


def test_mixing_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted((s for s in sizes if s is not None)))} | ({None: (len(sizes) - 1) % 3 + 1} if None in sizes else {})
    low, high = 0.0, 3.0 * sizes.total()
    for _ in range(200):  # the level at which the targets share all words
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * n, weight[s] * level) for s, n in sizes.items()) < sizes.total() else (low, level)
    want = Counter()
    for r in rows:
        rate = min(3.0, min(3 * sizes[r.source], weight[r.source] * level) / sizes[r.source])
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id] += math.floor(rate + 1e-9) + (u < rate - math.floor(rate + 1e-9))
    assert Counter(r.doc_id for r in corpus_pipeline.mixed_sources(spark, docs, SF).collect()) == +want


def test_documents_of_one_label_are_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i} " * 25) for i in range(300)], "doc_id int, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 1)], "doc_id int, quality int")
    rows, counts = quality.labelled_sample(docs, labels)
    assert len(rows) == 4 and counts == {1: 3, 0: 1}
