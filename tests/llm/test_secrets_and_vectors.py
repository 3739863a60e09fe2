"""Secret scans, vector codes and whitening against plain versions, and their edge cases."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import secret_scan, vector_codes, whitening

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SECRET = "Zk9vQx7LpT2mWb4RfY8sHd3J"


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


TEXTS = [
    "password=abcdefgh12 and TOKEN : 'short' api_key=\"0123456789abcdef0123456789abcdef\"",
    "password=secret: abcdefghij", "paſſword=notascii1 toKen=abcdefgh", "😀 𠀀 secret='a.b-c/d+e=' 😀 token=12345678",
    "AKIA AKIA1234567890ABC AKIA1234567890ABCDE x" + "a" * 31 + " " + "b" * 32, "f" * 200, "token=token=token=abcdefgh passwd  =  x" * 3,
    "", None, "   \n\t", f"the words of an ordinary sentence hold {SECRET} once", f"key {SECRET} {SECRET}\n{SECRET}= end", "password=" + SECRET,
    "internationalization_of_identifiers getOrdinaryNameOfThing some/path/of/ordinary/words", "1234567890123456 12345678901234567890", "secret:" + " " * 50 + "aaaaaaaaaa",
]


def test_spans_of_patterns(spark):
    rows = [(i, t, "x", "y", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string, kind string, start int")
    got = {r.row.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert [(s.start, s.kind, s.end) for s in got[i].spans if s.kind < 3] == plain_base(t or ""), t
        assert got[i].row.spans == "x" and got[i].row.start == 7


def test_random_strings_are_found_and_words_left(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("int"), "text")
    docs = plain.unionByName(spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string"))
    found = {r.row.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secret_scan.scan(docs).collect()}
    at = TEXTS.index(f"the words of an ordinary sentence hold {SECRET} once")
    assert found[1_000_000 + at] == [(TEXTS[at].index(SECRET), TEXTS[at].index(SECRET) + len(SECRET))]
    assert len(found[1_000_000 + at + 1]) == 3 and found[1_000_000 + at + 2] == []  # the pattern's span stays alone
    assert all(not v for k, v in found.items() if k not in (1_000_000 + at, 1_000_000 + at + 1))


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "password=abcdefgh1")] * 3 + [(1, "no"), (None, "token=abcdefgh1"), (None, "token=abcdefgh1"), (None, None)]
    got = [(r.row.doc_id, len(r.spans)) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1)] * 3 + [(1, 0), (None, 1), (None, 1), (None, 0)], key=repr)
    assert secret_scan.scan(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_very_long_text_with_many_matches(spark):
    text = "é token=abcdefgh " * 20_000
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [(s.start, s.kind, s.end) for s in row.spans] == plain_base(text)


def test_models_tell_held_out_strings_apart(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    syllables = ["con", "ter", "na", "tion", "al", "ize", "pre", "dict", "ing", "or", "der", "map", "to", "list"]
    random = ["".join(rng.choice(letters, 24)) for _ in range(800)]
    plain = ["".join(rng.choice(syllables, 7)) for _ in range(800)]
    samples = [(x, True) for x in random[:400]] + [(x, False) for x in plain[:400]]
    ratios = secret_scan.trained(spark.createDataFrame(samples, "value string, random boolean"))
    held = spark.createDataFrame([(x, True) for x in random[400:]] + [(x, False) for x in plain[400:]], "value string, random boolean")
    score = secret_scan.log_ratio(F.col("value"), ratios) / secret_scan.UNIT >= secret_scan.THRESHOLD * F.length("value")
    right = {r.random: r.n for r in held.where(score == F.col("random")).groupBy("random").agg(F.count("*").alias("n")).collect()}
    assert right[True] >= 396 and right[False] >= 399


def plain_codes(vectors, entries, rounds=4, parts=4):
    """vectors: lists in the order of ids; Python's integers throughout."""
    x = [[math.floor(1024 * c) for c in v] for v in vectors]
    size, more = divmod(len(x[0]), parts)
    ends = np.cumsum([0] + [size + (p < more) for p in range(parts)])
    cut = [[tuple(v[a:b]) for v in x] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    books = [[v for v in part[:entries]] for part in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p, part in enumerate(cut):
            got = [nearest(v, books[p])[1] for v in part]
            for e in range(len(books[p])):
                mine = [v for v, g in zip(part, got, strict=True) if g == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    found = [[nearest(v, books[p]) for v in part] for p, part in enumerate(cut)]
    codes = ["".join(f"{found[p][i][1]:02x}" for p in range(parts)) for i in range(len(x))]
    return codes, [sum(found[p][i][0] for p in range(parts)) for i in range(len(x))], [[list(e) for e in b] for b in books]


@pytest.mark.parametrize(("n", "length", "scale", "entries"), [(300, 8, 1.0, 16), (5, 6, 3.0, 256), (40, 3, 0.01, 8), (60, 8, 1e9, 4), (1, 4, 1.0, 256)])
def test_codes_against_plain_version(spark, n, length, scale, entries):
    rng = np.random.default_rng(n)
    v = (rng.standard_normal((n, length)) * scale).astype(np.float32)
    v[n // 2] = v[0]  # repeated vectors, ties
    rows = [(int(i), [float(c) for c in x], "code", "error") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string, row string").repartition(3)
    got, books = vector_codes.compress(df, entries=entries)
    codes, errors, want = plain_codes([r[1] for r in rows], entries)
    assert [[[int(c) for c in e] for e in b] for b in books] == want
    assert [(r.code, r.error) for r in sorted(got.collect(), key=lambda r: r.row.vec_id)] == [(c, e if e < 1 << 63 else None) for c, e in zip(codes, errors, strict=True)]
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(c) for b in want for e in b for c in e).encode()).hexdigest()
    back = {r.row.row.vec_id: r.vector for r in vector_codes.decoded(got, books).collect()}
    flat = [np.concatenate([want[p][int(codes[i][2 * p : 2 * p + 2], 16)] for p in range(4)]) / 1024 for i in range(n)]
    assert all(np.array_equal(back[i], flat[i]) for i in range(n))


BAD = [(90, None), (91, []), (92, [1.0, None]), (93, [float("nan"), 1.0]), (94, [float("inf"), 1.0]), (95, [1.0]), (96, [1.0, 2.0, 3.0]), (97, [2.0**60, 1.0])]
GOOD = [(3, [0.5, -0.25]), (1, [0.25, 1.0]), (1, [0.25, 0.5]), (None, [-0.001, 0.125]), (2, [0.5, -0.25])]


def test_codes_of_unusable_rows_and_labels(spark):
    rows = [(i, v, None if k % 2 else 5) for k, (i, v) in enumerate(GOOD)] + [(i, v, 5) for i, v in BAD]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, books = vector_codes.compress(df, entries=2)
    out = vector_codes.with_label_error(got).collect()
    order = [v for _, v in sorted(GOOD, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    codes, errors, want = plain_codes(order, 2)
    assert [[[int(c) for c in e] for e in b] for b in books] == want
    assert sorted(r.code for r in out) == sorted(codes) and sorted(r.error for r in out) == sorted(errors)
    for label in (None, 5):
        mine = [r for r in out if r.row.label == label]
        assert mine and all(r.label_error == sum(x.error for x in mine) for r in mine)
    empty, none = vector_codes.compress(df.where("vec_id > 89 and vec_id <> 95 and vec_id <> 96"))
    assert empty.collect() == [] and none == []


def plain_whitening(vectors, k):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=np.float64)
    c = x - x.sum(axis=0) / len(x)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    return e, u[:, :k], c


@pytest.mark.parametrize(("n", "length", "decay"), [(400, 12, 0.8), (300, 40, 1e-3), (300, 40, 0.97), (50, 3, 0.5)])
def test_whitening_against_eigenvectors(spark, n, length, decay):
    rng = np.random.default_rng(length)
    turn, _ = np.linalg.qr(rng.standard_normal((length, length)))
    v = (rng.standard_normal((n, length)) * decay ** np.arange(length) * 50) @ turn
    rows = [(int(i), x.tolist(), "w") for i, x in enumerate(v)]
    table, found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(4))
    e, u, c = plain_whitening(v, 8)
    k = min(8, length)
    assert found.values == pytest.approx(e[:k], rel=1e-9, abs=1e-14 * e[0]) and found.trace == pytest.approx(e.sum(), rel=1e-12)
    got = np.array([r.whitened for r in sorted(table.collect(), key=lambda r: r.row.vec_id)])
    want = c @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * want).sum(axis=0))
    sure = [j for j in range(k) if e[j] > 1e-6 * e[0] and min([abs(e[j] - x) for i, x in enumerate(e) if i != j]) > 1e-3 * e[j]]
    assert sure and np.abs(got * sign - want)[:, sure].max() < 1e-6
    assert whitening.identity_error(table, k) < 1e-4
    x = [[math.floor(1024 * a) + 100_000 for a in r] for r in v]
    s = [sum(col) for col in zip(*x, strict=True)]
    assert [r.deviation for r in sorted(table.collect(), key=lambda r: r.row.vec_id)] == [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


def test_whitening_expands_only_where_it_must(spark):
    rng = np.random.default_rng(1)
    steep = rng.standard_normal((200, 30)) * np.concatenate((1.0 + np.arange(8), np.full(22, 1e-6))) * 1000
    flat = rng.standard_normal((200, 30))
    for v, expands in ((steep, False), (flat, True)):
        _, found = whitening.whiten(spark.createDataFrame([(x.tolist(),) for x in v], "embedding array<double>"))
        assert (found.passes > whitening.PASSES) == expands


def test_whitening_of_unusable_and_few_rows(spark):
    df = spark.createDataFrame([*GOOD, *BAD], "vec_id long, embedding array<double>")
    table, found = whitening.whiten(df)
    assert found.n == 5 and table.count() == 5
    one, alone = whitening.whiten(df.where("vec_id = 3"))
    assert [r.whitened for r in one.collect()] == [[None, None]] and one.first().deviation == 0
    assert whitening.identity_error(one, 2) is None and alone.trace == 0
    flat, _ = whitening.whiten(spark.createDataFrame([([float(i), 7.0],) for i in range(9)], "embedding array<double>"))
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in flat.collect()) and whitening.identity_error(flat, 2) < 1e-9
    none, nothing = whitening.whiten(df.where("vec_id in (90, 93)"))
    assert none.collect() == [] and nothing is None


def test_whitening_query(spark):
    rows = whitening.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    held = duckdb.sql(f"SELECT embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    e, u, c = plain_whitening([r[0] for r in held], 8)
    got, want = rows["whitened"].to_numpy().reshape(-1, 8), c @ u / np.sqrt(e[:8])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose(rows["explained"].to_numpy()[:8], e[:8] / e.sum(), rtol=1e-9) and rows["identity_error"].max() < 1e-9
    assert set(rows["n"]) == {len(held)} and list(rows["component"][:8]) == list(range(1, 9))
