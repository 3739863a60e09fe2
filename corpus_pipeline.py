"""A corpus pipeline of four stages, each on all that the one before it kept.

Quality rules drop what fails them; of each group of near-duplicates one document stays; sources are mixed to
their weights, so documents leave or repeat; the rest is encoded and decoded. All stages but the last return
the columns of ``documents``.

Defined cases. Null, empty and short texts fail the quality rules, so no later stage sees them. Very long texts are judged, compared,
counted and encoded whole. Repeated rows and equal texts are near-duplicates: the one of smallest id stays (null ids last). A null source is a source of its own, a
null id is drawn as the empty string. Without labels of both classes the base rules decide alone. No documents: no rows. Further columns go through all
stages but the last, whatever their names. What a stage wrote is dropped when the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import digests, encode
from tidemark.llm.common import discard, scratch, table
from tidemark.llm.mixing import mix
from tidemark.llm.quality import keep_good
from tidemark.llm.simhash import drop_near_duplicates

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that are encoded at once; the stages before leave less memory than an encoder alone has.
STRETCH = 2 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, repeats included."""
    ranks = public_tokenizers.path(RANKS)
    return digests(encode(docs, ranks, public_tokenizers.PATTERN, stretch=STRETCH, decoded=True))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mixed_sources), ("byte-level BPE encoding and decoding", byte_level_bpe)]
#: The fitted classifier and the fingerprints are beyond SQL; the tests hold the near-duplicate stage against brute force,
#: encoding against its own input, and quality and mixing against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.split()[0].lower())
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
