"""Every registered query of the subpackage over the smallest data: against its SQL, or against a plain version of it."""

import base64
import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import lm, quality
from tidemark.llm.common import written
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test data isn't here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def run(spark, name, *columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, SF).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_token_store(spark, documents):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for r in sorted(documents, key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert run(spark, "op1_token_store", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = collections.defaultdict(list)
    for r in QUERIES["op4_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]]
        have = got.pop(q)
        assert len(have) == len(want) and all(x == pytest.approx(s[ids == i][0], abs=1e-12) for i, x in have)
        hits.append(len(set(want.tolist()) & {i for i, _ in have}) / len(want))
    assert not got and np.mean(hits) >= 0.9


def test_simhash(spark, documents):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r.doc_id: fingerprint(r.text) for r in documents}
    x, ids = np.array(list(prints.values()), dtype=np.uint64), list(prints)
    root = list(range(len(ids)))
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1)), strict=True):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    least = {r: min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    want = [(d, f"{prints[d]:016x}", least[root[k]]) for k, d in enumerate(ids)]
    assert run(spark, "op5_simhash", "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_bpe(spark, documents):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in documents:
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert run(spark, "op6_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


U = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & U
    x = (x ^ x >> 27) * 0x94D049BB133111EB & U
    return x ^ x >> 31


def plain_features(text):
    """The hashed features of each kind, one by one."""
    shift = 64 - quality.DIMENSION.bit_length() + 1
    words = [mix(sum(mix(b + (i << 8) + 7) for i, b in enumerate(w.encode())) & U) for w in WORD.findall(text)]
    points = [ord(c) for c in text]

    def gram(xs):
        code = 0
        for x in xs:
            code = (code * 0x100000001B3 + x) & U
        return (code * 0x9E3779B97F4A7C15 & U) >> shift

    return [
        [w >> shift for w in words], [mix((a * 3 + b) & U) >> shift for a, b in zip(words, words[1:], strict=False)],
        [gram(points[i : i + 3]) for i in range(len(points) - 2)], [gram(points[i : i + 5]) for i in range(len(points) - 4)],
    ]


def test_quality(spark, documents, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 1000)  # longer texts are hashed in pieces
    model = quality.trained(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = {}
    for r in documents:
        text = r.text or ""
        w = WORD.findall(text)
        found = collections.defaultdict(list)
        for i in range(len(w) - 7):
            found[tuple(w[i : i + 8])].append(i)
        repeated = len({j for v in found.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        score = model.bias + sum(np.mean(model.weights[k][f]) for k, f in enumerate(plain_features(text)) if f)
        p = 1 / (1 + math.exp(-max(-50, min(50, model.slope * score + model.offset))))
        want[r.doc_id] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed), p
    got = QUERIES["op7_quality"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        base, p = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        assert r.probability == pytest.approx(p, abs=1e-5) and (r.kept == (not r.base_failed and p >= 0.5) or abs(p - 0.5) < 1e-5)


def test_quality_held_out(spark, documents):
    """Labels that the classifier wasn't fitted on: of every third document."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.trained(docs, labels.where("doc_id % 3 <> 0"))
    judged = {r.doc_id: r.probability for r in quality.judge(docs.select("doc_id", "text"), model).where("not base_failed").select("row.doc_id", "probability").collect()}
    unseen = [(r.quality, judged[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in judged]
    assert len(unseen) > 10 and np.mean([(p >= 0.5) == (q == 1) for q, p in unseen]) >= 0.9


def test_sharding(spark, documents):
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_language_model(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    training = docs.where(~lm.held_out(F.col("doc_id")))
    counts = written(lm.count_tokens(training), "counts")
    lex = lm.lexicon(counts)
    model = lm.train(training, lex, spark.sparkContext.broadcast(lex))
    n = {bytes(r.word): r.n for r in counts.collect()}
    tokens = lambda t: [*(w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), b""]
    plain_n = collections.Counter(w for r in documents if zlib.crc32(str(r.doc_id).encode()) % 10 for w in tokens(r.text))
    assert n == plain_n
    total, distinct = sum(n.values()), len(n)
    single = sorted(n, key=lambda w: (w != b"", -n[w], w))[: lex.single]
    own = {w: i for i, w in enumerate(single)}
    cls = lambda w: own.get(w, lex.single + zlib.crc32(w[-3:]) % (lex.classes - lex.single))
    in_class, words_in = collections.Counter(), collections.Counter()
    for w, c in n.items():
        in_class[cls(w)] += c
        words_in[cls(w)] += 1
    r_, q, c = (model.p[k].astype(np.float64) for k in "rqc")

    def score(text):
        out, h1, h2 = 0.0, 0, 0
        for w in tokens(text):
            logits = q[:, :-1] @ (r_[h1] * c[0] + r_[h2] * c[1]) + q[:, -1]
            k = cls(w)
            out += (logits[k] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if k >= lex.single:
                out += math.log10((n.get(w, 0) + 0.1) / (in_class[k] + 0.1 * (words_in[k] + 1)))
            h1, h2 = k, h1
        return out

    got = {r.doc_id: r for r in QUERIES["op10_lm"](spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        w, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(x in n for x in w), total)
        assert g.base_score == pytest.approx(sum(math.log10((n.get(x, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), rel=1e-9)
    for r in sorted(documents, key=lambda r: len(r.text or ""))[::10]:
        assert got[r.doc_id].score == pytest.approx(score(r.text), rel=1e-4, abs=1e-3)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_sums_to_one(spark):
    """The classes, and the words of a class with one unknown word, have probabilities that add up to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts = written(lm.count_tokens(docs), "counts")
    lex = lm.lexicon(counts)
    words = {bytes(r.word): r.n for r in counts.collect()}
    _, cls = lex.find(list(words))
    shares = collections.defaultdict(float)
    for (w, c), k in zip(words.items(), cls, strict=True):
        shares[k] += 10 ** (math.log10(c + 0.1) - lex.class_log[k])
    assert len(shares) > lex.single
    for k, s in shares.items():
        # a class of one word has no other
        unknown = 10 ** (math.log10(0.1) - lex.class_log[k]) if k >= lex.single else 0
        assert s + unknown == pytest.approx(1, abs=1e-9), k
