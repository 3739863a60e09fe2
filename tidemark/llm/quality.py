"""Quality rules: base counts, and a classifier over hashed word and character n-grams.

Base counts are exact for whole texts. The classifier is a logistic regression on the mean of hashed features
(words, word pairs, and 3-grams and 5-grams of characters, as code points), trained on labelled rows: at most ``sample`` of each class, those with the
least hash of their id. A fifth of them is held out to calibrate probabilities (Platt), weighted to the share that
each class has among all labels. Texts are scored in Arrow batches and kept at a fixed probability.

Defined cases. Null text: no words, so it fails the base. Null labels or ids without a text: not trained on. Repeated
ids among the labels: each row counts, among the documents: the text of least hash is trained on, all are judged. Labels of one class or none: the classifier keeps all. Repeated rows: alike.
Empty table: no rows. Further columns are ignored, or kept by ``keep_good``; those named like the added ones are too.
A very long text is held whole, its words and code points as arrays of some twenty times its bytes, and hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parts, table, words_of

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 1000
#: Least probability of good quality that is kept.
KEEP_AT = 0.5
#: Fewest words, and the largest percentage of them in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
DIMENSION, KINDS = 1 << 16, 4
#: Words or characters that are hashed at once.
PIECE = 1 << 20
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Whole texts as arrays: their bytes, and their words as numbers (equal words, equal numbers)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.texts = texts.cast(pa.binary()).to_pylist()
        self.n_bytes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.spelled, self.words, self.of = words_of(texts)
        self.n_words = np.bincount(self.of, minlength=len(self.texts))

    def base(self) -> dict[str, np.ndarray]:
        starts = (self.bytes & 0xC0) != 0x80
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in self.texts]
        repeated = self.repeated()
        failed = (self.n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * self.n_words)
        return {
            "n_words": self.n_words, "word_chars": _sums(starts & ~_SPACE[self.bytes], self.n_bytes), "n_symbols": _sums(_SYMBOL[self.bytes], self.n_bytes),
            "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64), "n_repeat_words": repeated, "base_failed": failed,
        }

    def repeated(self) -> np.ndarray:
        """Words of each text in windows that it has twice or more. Equal hashes are held against the words."""
        n = len(self.words) - WINDOW + 1
        if n <= 0:
            return np.zeros(len(self.texts), dtype=np.int64)
        r = _mix(self.words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x100000001B3) + r[k : k + n]
        h = _mix(h + _mix(self.of[:n].astype(np.uint64) + np.uint64(1)))
        within = np.flatnonzero(self.of[:n] == self.of[WINDOW - 1 :])
        order = within[np.argsort(h[within], kind="stable")]
        a, b = order[:-1], order[1:]
        same = h[a] == h[b]
        a, b = a[same], b[same]
        equal = self.of[a] == self.of[b]
        for k in range(WINDOW):
            equal &= self.words[a + k] == self.words[b + k]
        marks = np.zeros(len(self.words) + 1, dtype=np.int64)
        hit = np.unique(np.concatenate((a[equal], b[equal])))
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + WINDOW, -1)
        return _sums(np.cumsum(marks[:-1]) > 0, self.n_words)

    def features(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each kind, in pieces: its number, hashed features, and the text of each."""
        shift = np.uint64(64 - DIMENSION.bit_length() + 1)
        if len(self.spelled):
            # a word's hash: its bytes, mixed with their places
            data = np.frombuffer(b"".join(self.spelled.to_pylist()), dtype=np.uint8).astype(np.uint64)
            sizes = pc.binary_length(self.spelled).to_numpy().astype(np.int64)
            firsts = np.cumsum(sizes) - sizes
            place = np.arange(len(data)) - np.repeat(firsts, sizes)
            own = _mix(np.add.reduceat(_mix(data + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(7)), firsts))
            for a in range(0, len(self.words), PIECE):
                w, of = own[self.words[a : a + PIECE + 1]], self.of[a : a + PIECE + 1]
                yield 0, (w[:PIECE] >> shift).astype(np.int64), of[:PIECE]
                pair = of[:-1] == of[1:]
                yield 1, (_mix(w[:-1] * np.uint64(3) + w[1:])[pair] >> shift).astype(np.int64), of[:-1][pair]
        points = [t.decode("utf-8", "replace").encode("utf-32-le") for t in self.texts]
        text = np.repeat(np.arange(len(points), dtype=np.int32), [len(x) // 4 for x in points])
        wide = np.frombuffer(b"".join(points), dtype="<u4")
        for kind, n in ((2, 3), (3, 5)):
            for a in range(0, len(wide) - n + 1, PIECE):
                x, of = wide[a : a + PIECE + n - 1].astype(np.uint64), text[a : a + PIECE + n - 1]
                m = len(x) - n + 1
                code = np.zeros(m, dtype=np.uint64)
                for k in range(n):
                    code = code * np.uint64(0x100000001B3) + x[k : k + m]
                within = of[:m] == of[n - 1 :]
                yield kind, ((code * np.uint64(0x9E3779B97F4A7C15))[within] >> shift).astype(np.int64), of[:m][within]


@dataclass
class Model:
    """Weights of each kind's hashed features, bias, and the calibration of scores."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, s: Slice) -> np.ndarray:
        n, total = np.zeros((KINDS, len(s.texts))), np.zeros((KINDS, len(s.texts)))
        for kind, feature, text in s.features():
            n[kind] += np.bincount(text, minlength=len(s.texts))
            total[kind] += np.bincount(text, weights=self.weights[kind, feature], minlength=len(s.texts))
        return self.bias + (total / np.maximum(n, 1)).sum(axis=0)

    def probability(self, s: Slice) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(s) + self.offset, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> tuple[list, dict[int, int]]:
    """Rows (quality, held out, features, values) of at most ``sample`` labelled rows of a class, and the labels' counts.

    Features are made on the executors; what reaches the driver is bounded by the sample and the dimension.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64(F.lit("quality"), "doc_id")
    some = [known.where(F.col("quality") == q).orderBy(h, "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0))
    # of the documents of one id, one is trained on, so the sample bounds them whatever their number
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    texts = one.join(chosen, "doc_id").select("text", "quality", "held", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20):
            n = part.num_rows
            key, count, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((KINDS, n))
            for kind, feature, of in Slice(part.column(0)).features():
                total[kind] += np.bincount(of, minlength=n)
                key, at = np.unique(np.concatenate((key, (of.astype(np.int64) * KINDS + kind) * DIMENSION + feature)), return_inverse=True)
                count = np.bincount(at, weights=np.concatenate((count, np.ones(len(feature)))))
            doc, feature = np.divmod(key, KINDS * DIMENSION)
            value = count / total[feature // DIMENSION, doc]
            ends = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), *lists], ["quality", "held", "doc_id", "feature", "value"])

    got = texts.mapInArrow(run, f"quality int, held boolean, doc_id {dict(docs.dtypes)[doc_id]}, feature array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    rows = [(q, h, f.values.to_numpy(), v.values.to_numpy()) for q, h, f, v in zip(got["quality"].to_pylist(), got["held"].to_pylist(), got["feature"], got["value"], strict=True)]
    return rows, counts


def fit(rows: list, counts: dict[int, int], steps: int = 120, rate: float = 1.0, decay: float = 1e-6) -> Model | None:
    """Balanced logistic regression by Adam; None without rows of both classes to train on."""
    train, held = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    if {r[0] for r in train} != {0, 1}:
        return None
    y, sizes = np.array([r[0] for r in train]), np.array([len(r[2]) for r in train])
    feature, value = np.concatenate([r[2] for r in train]), np.concatenate([r[3] for r in train]).astype(np.float64)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, bias, m, v, mb, vb = np.zeros(KINDS * DIMENSION), 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(1, steps + 1):
        z = _sums(value * w[feature], sizes) + bias
        g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad, gb = np.bincount(feature, weights=value * np.repeat(g, sizes), minlength=len(w)) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        scale = rate / (1 - 0.9**t)
        w = w - scale * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        bias -= 0.1 * scale * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-5)
    rest = held if {r[0] for r in held} == {0, 1} else train
    z = np.array([r[3] @ w[r[2]] + bias for r in rest])
    y = np.array([r[0] for r in rest])
    n = np.bincount(y, minlength=2)
    weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0]) / (counts[0] + counts[1])
    # Platt's targets keep the slope finite where the classes are apart
    goal = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, ab = np.stack([z / max(z.std(), 1e-9), np.ones_like(z)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (p - goal)))
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Model(w.reshape(KINDS, DIMENSION), bias, ab[0] / max(z.std(), 1e-9), ab[1])


def judge(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """A struct ``row`` with all columns of ``docs``, the base counts, ``probability`` (null without a model) and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.weights.astype(np.float32), model.bias, model.slope, model.offset))
    names = [x.split()[0] for x in BASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Model(*shared.value)
        for part in parts(batches, "text", 1 << 20):
            s = Slice(part.column(1))
            base = s.base()
            p = model.probability(s) if model else None
            kept = ~base["base_failed"] & (p >= keep_at if model else True)
            scores = pa.array(p) if model else pa.nulls(part.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(base[x]) for x in names], scores, pa.array(kept)], ["row", *names, "probability", "kept"])

    schema = docs.select(F.struct(*docs.columns).alias("row")).schema.simpleString().removeprefix("struct<").removesuffix(">")
    return docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")).mapInArrow(run, f"{schema}, {BASE}, probability double, kept boolean")


def trained(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    return fit(*labelled_sample(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that pass the base and the classifier."""
    return judge(docs, trained(docs, labels), keep_at).where("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
