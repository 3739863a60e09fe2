"""Each operator against a brute-force version, over nulls, empty, long, repeated and clashing rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, components, lm, mixing, neighbours, quality, sharding, simhash, token_store, url_filter, warc
from tidemark.llm.common import scratch, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, row int, shard int, copies string, kept string, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randint(1, 120)) for _ in range(40)]
    near = prose(400)
    return [None, "", " \t\n ", "one", "ONE two", *base, base[0], base[0], base[1].upper(), near, near + " tail", near.replace(" ", "\n", 30), prose(30_000), "é " * 50 + "  中文 １２3 !?#", "same line\nsame line\n\nother\n" * 8, "a b\x1cc\x85d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", None, -1, "x", 1, 9, "c", "k", 0) for i, t in enumerate(texts())]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_store_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path, t = P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = scratch(spark, "t")
    token_store.write_tokens(docs, out, path)
    got = token_store.checksums(token_store.read_tokens(spark, out)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    want = collections.Counter()
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1])
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)
    none = scratch(spark, "t")
    token_store.write_tokens(empty, none, path)
    assert token_store.checksums(token_store.read_tokens(spark, none)).count() == 0


def test_token_store_spares_offsets():
    """New words go through the library's way without offsets, many in one call."""
    from types import SimpleNamespace

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    e, t = token_store.WordEncoder(path, 1), Tokenizer.from_file(path)
    calls, fast = [], e.bare.encode_batch_fast
    e.bare = SimpleNamespace(encode_batch_fast=lambda texts, **k: (calls.append(len(texts[0].split())), fast(texts, **k))[1])
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcéñß'9.,!光") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 1, 700]))) for _ in range(12)] + [None, "don't <|endoftext|> \u00a0x\u0301 \x00 y\u2028z"]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    ids, sizes = e.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert calls and max(calls) > 500


def test_token_store_remembers_little(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "REMEMBERED", 50)
    path = P.path("word_bpe_49k.json")
    e, t = token_store.WordEncoder(path, 1), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = " \n\t　\x1c\x85abcABC'slltvéÉİßŒ中١٣!?#…̈<|endoftext|>  "
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["a<|endoftext|>b", "it's 'sfoo ''S"]
    for at in range(0, len(some), 50):
        part = some[at : at + 50]
        ids, sizes = e.encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in part]


def test_url_filter_aliases(spark):
    page = lambda link: f'<html><head><link href="{link}" rel="canonical"></head></html>'
    rows = [
        (1, "http://bad.net/x", None), (2, "http://A.com/copy#f", page("http://bad.net/x")), (3, "http://a.com/far", page("/copy")),
        (4, "http://www.example.net/en/1", page("http://bad.net/x")), (5, "http://b.com/", "<p>"), (6, None, None), (7, "nourl", page("http://bad.net/x")),
        (8, "http://c.org/fr/1?q#z", None), (9, "http://net", None), (1, "http://bad.net/x", None), (10, "http://d.com/r", '<META HTTP-EQUIV=refresh content="0; url=//e.net/y">'),
        (11, "http://snet/", None), (12, "http://example.com/de/", None), (13, "http://f.com/", None), (14, "http://g.com/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://f.com/", "http://x.net/"), ("http://g.com/", "http://f.com/"), (None, "http://f.com/")], "from_url string, to_url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.RULES, redirects).collect()}
    verdict = {k: r.verdict for k, r in got.items()}
    # the component of 1 to 4 has an explicit allow, which takes precedence; page 1 keeps its own rule
    assert verdict == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "block", 13: "block", 14: "block"}
    assert got[4].rule == "example.net/en/" and got[9].rule is None and (got[9].host, got[9].path) == ("net", "") and got[6].host == "" and got[2].host == "a.com"
    many = [url_filter.Rule.of("block", f"h{i}.org/") for i in range(300)] + list(url_filter.RULES)
    again = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, many, redirects).collect()}
    assert again == verdict
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_mixing(spark, docs, empty):
    plan = mixing.plan_mix(docs).collect()
    sizes = {}
    for r in plan:
        assert r["size"] == len(WORD.findall(r.row.text or ""))
        sizes[r.row.source] = sizes.get(r.row.source, 0) + r["size"]
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    full, level = set(), 0.0
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[k] for k in full)) / sum(weight[k] for k in order if k not in full)
        more = {k for k in order if k not in full and weight[k] * level > 3 * sizes[k]}
        if not more:
            break
        full |= more
    for r in plan:
        source = r.row.source
        assert r.target == pytest.approx(3 * sizes[source] if source in full else weight[source] * level)
        rate = min(3.0, r.target / sizes[source]) if sizes[source] else 0
        u = int(hashlib.md5(f"mix:{r.row.doc_id if r.row.doc_id is not None else ''}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == math.floor(rate) + (u < rate - math.floor(rate)) <= 3
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in plan)
    assert mixing.mix(empty).count() == 0


def test_neighbours_recall_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 16)).astype(np.float32) * rng.uniform(0.2, 3, (3000, 1)).astype(np.float32)
    v[2000:2600] = v[40]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] * 16, 0), (None, [1.0] * 16, 0), (5080, [1.0, 2.0], 0), (5081, [2.0, 1.0], 0), (20, v[20].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w, hits = v.astype(np.float64), []
    for q in range(0, 3000, 20):
        s = w @ w[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        have = got.pop(q)
        assert len(have) == 20 and all(abs(x - s[i]) < 1e-9 for i, x in have) and [x for _, x in have] == sorted((x for _, x in have), reverse=True)
        hits.append(len({i for i, _ in have} & set(want.tolist())) / 20)
        if q == 40:
            assert [i for i, _ in have] == sorted(i for i, _ in have) or len({x for _, x in have}) > 1
    assert np.mean(hits) >= 0.9
    assert got == {5080: [(5081, 4.0)]}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def simhash_of(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, docs, empty):
    rows = docs.collect()
    prints = [simhash_of(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group, strict=True)), key=repr)
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("leaf", "part"), [(100, 80), (10_000, 10_000)])
def test_near_links_are_exact(spark, leaf, part):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = sorted({int(x) for x in np.concatenate((base, near))})
    nodes = spark.createDataFrame([(bytes(4) + x.to_bytes(8, "big"),) for x in values], "node binary")
    links = simhash.near_links(nodes, 3, leaf=leaf, part=part)
    got = {bytes(r.node)[4:]: bytes(r.component)[4:] for r in components.components(links, "a", "b").collect()}
    x = np.array(values, dtype=np.uint64)
    parent = list(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1)), strict=True):
        a, b = i, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    want = {values[i].to_bytes(8, "big"): values[root(i)].to_bytes(8, "big") for i in range(len(x))}
    assert {k: got.get(k, k) for k in want} == want


def test_drop_near_duplicates(spark, docs, empty):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    t = texts()
    ids = collections.Counter(r.doc_id for r in kept.collect())
    near = next(i for i, x in enumerate(t) if x and x.endswith(" tail"))
    assert near - 1 in ids and near not in ids and near + 1 not in ids  # near copies leave
    assert 5 in ids and 45 not in ids and 46 not in ids  # copies leave
    assert ids[6] == 1 and all(n == 1 for k, n in ids.items() if k is not None)
    assert ids[None] == 1  # "no id"; the null text is a copy of the empty one
    assert all(i in ids for i in range(5, 45))
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_bpe_matches_the_library_and_round_trips(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert by_row(bpe.digests(bpe.encode(docs, path, P.PATTERN, decoded=True)), *columns) == sorted(want, key=repr)
    assert by_row(bpe.digests(bpe.decode(bpe.encode(docs, path, P.PATTERN, stretch=1000), path)), *columns) == sorted(want, key=repr)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    rng = random.Random(1)
    letters = " \n\t　\x1c\x85abcABC'slltvé中文日本123٣!?#…😀\r  "
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["aaaaaaaaa", " aaaa aaaaa", "ab" * 40]
    ids, ends = bpe.Encoder(ranks, P.PATTERN).encode(some)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [own.encode_ordinary(x) for x in some]


def base_of(text):
    t = text or ""
    w = WORD.findall(t)
    found = collections.defaultdict(list)
    for i in range(len(w) - 7):
        found[tuple(w[i : i + 8])].append(i)
    covered = {j for v in found.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered), failed


def test_quality_base_and_classifier(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.trained(docs, none) is None
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.judge(docs, None).select("row.doc_id", *columns, "kept").collect()
    want = collections.Counter((r.doc_id, *base_of(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(empty, none).count() == 0
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    good = [" ".join(word() for _ in range(60)) for _ in range(80)]
    bad = [" ".join(word() + rng.choice(["***", "%%%"]) for _ in range(60)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 160, 2)] + [(None, 1, 0), (1, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.trained(table, labels)
    verdict = {r.doc_id: r.kept for r in quality.judge(table, model).select("row.doc_id", "kept").collect()}
    unseen = [i for i in range(160) if i % 2]
    assert np.mean([verdict[i] == (i < 80) for i in unseen]) > 0.95


def test_sharding_is_a_balanced_permutation(spark, docs, empty):
    def shards(**options):
        path = scratch(spark, "s")
        sharding.write_shards(docs, path, **options)
        return sharding.read_shards(spark, path, docs)

    got = shards()
    rows = got.collect()
    n = docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == n and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order != sorted(order)
    assert by_row(shards(), "doc_id", "text", "shard", "slot") == by_row(got, "doc_id", "text", "shard", "slot")
    assert by_row(shards(seed=1), "doc_id", "text", "shard", "slot") != by_row(got, "doc_id", "text", "shard", "slot")
    path = scratch(spark, "s")
    sharding.write_shards(empty, path)
    assert sharding.read_shards(spark, path, empty).count() == 0


def test_warc_round_trip(spark):
    large = "é" * 80
    rows = [(3, "http://a/", large), (1, None, large), (2, "http://a/ b\n", large), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (1, None, large), (None, "n", large), (None, "n", "x\r\n\r\ny" * 50), (7, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = scratch(spark, "w")
    crawl = warc.write_monolithic(warc.with_revisits(pages), f"{path}/crawl", roll_mb=0)
    manifest = warc.normalise(crawl, f"{path}/archive")
    got = warc.read_archives(manifest, stretch=2)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = 1 if html == large else None
        other = first if first is not None and i != first else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", other))
    assert by_row(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    none = warc.write_monolithic(warc.with_revisits(pages.limit(0)), f"{path}/none")
    assert warc.read_archives(warc.normalise(none, f"{path}/empty")).count() == 0


def test_warc_normaliser_takes_one_stream_or_many():
    import io

    records = [warc.record(i, f"http://x/{i}", b"p" * i * 7, "0" * 64, None) for i in range(50)]
    whole = zlib.compressobj(wbits=31)
    one = whole.compress(b"".join(records)) + whole.flush()
    many = b"".join((z := zlib.compressobj(wbits=31)).compress(r) + z.flush() for r in records)
    for data in (one, many):
        for size in (7, 1 << 20):
            assert list(warc.records_of(warc.inflated(io.BytesIO(data), size))) == records
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of(warc.inflated(io.BytesIO(one[:-10]))))


def test_lm_base_and_model(spark, docs, empty, monkeypatch):
    rng = random.Random(4)
    tongues = [["".join(rng.choice(a) for _ in range(rng.randint(2, 5))) for _ in range(150)] for a in ("abcd", "wxyz")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(80))) for i in range(400)] + [(r.doc_id, r.text) for r in docs.collect()]
    table = written(spark.createDataFrame(rows, "doc_id long, text string"), "lm")
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    n = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(n.values()), len(n)
    monkeypatch.setattr(lm, "REMEMBERED", 100)  # the others are joined
    training = table.where(~lm.held_out(F.col("doc_id")))
    counts = written(lm.count_tokens(training), "counts")
    lex = lm.lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)
    model = lm.train(training, lex, shared)
    got = lm.score(table, counts, lex, shared, model).collect()
    want = collections.Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, held(i), len(w), sum(x in n for x in w), total, round(sum(math.log10((n[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 4)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    unseen = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    a1, a2, norm = model.tables()
    for h1, h2 in ((0, 0), (5, 60), (50, 3)):
        assert np.exp(a1[:, h1].astype(float) + a2[:, h2] - norm[h1, h2]).sum() == pytest.approx(1, abs=1e-4)
    none = written(lm.count_tokens(empty), "counts")
    lone = lm.lexicon(none)
    first = lm.score(table.where("doc_id = 0"), none, lone, spark.sparkContext.broadcast(lone), lm.Model(lone.class_counts)).first()
    assert first.base_score == pytest.approx(0) and first.n_known == 0
    assert lm.score(empty, counts, lex, shared, model).count() == 0
