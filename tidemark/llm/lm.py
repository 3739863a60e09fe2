"""Language-model scores: a log-bilinear model by noise-contrastive estimation.

Words are counted over all training documents. Each word belongs to one class: a frequent word is a class of
its own, the rest share classes by their last bytes, within which words have smoothed shares of the counts. The number
of classes grows with that of distinct words.
A log-bilinear model predicts the class from the two before it: a class's score is its target vector times the
sum of the context vectors, each scaled by its place, plus a bias. It is trained in numpy by noise-contrastive
estimation, with every training token: tasks train from common parameters, which are averaged by tokens after each
round. For scores, matrix products give the normaliser of every context at once, so that log-probabilities are exact.

The most frequent words (at most ``REMEMBERED``, whole bins of equal frequency) travel to the workers with their counts; tokens
beyond are joined with the table of all counts, so no token is dropped.

Defined cases. Null text: the end token alone. Null id: held out (the crc32 of the empty string is 0). Repeated rows: each counts and is scored.
No training documents: every token has log-probability 0 in the base, and the model knows no class. Empty table: no rows.
Further columns are ignored. A very long text is coded whole, in arrays of some ten times its bytes. Tasks train on
their own documents, so ``score`` depends on how files are split into tasks; with the same split, reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parts, table, words_of, written

#: The end of a document as a token; no word is empty.
END = b""
WIDTH, REMEMBERED = 24, 400_000
#: Classes grow as the root of the number of distinct words, between these bounds; half are single words. The upper one
#: bounds a worker's tables, which have a place for every pair of classes.
FEWEST, MOST = 512, 1536
#: Share of the training documents in each round, in hundredths, and the rate of learning.
ROUNDS, RATE = ((0, 20), (20, 100)), 0.5
BATCHES, NOISE = (16, 512), 64
#: Bytes of text that are coded at once, and distinct words that a counting task holds.
STRETCH, HELD = 4 << 20, 400_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens (binary), and for every token its number among them and its text; the end of each text is its last token."""
    spelled, index, text = words_of(pc.ascii_lower(texts.cast(pa.string())))
    ends = np.cumsum(np.bincount(text, minlength=len(texts)))
    return pa.concat_arrays([spelled, pa.array([END], pa.binary())]), np.insert(index, ends, len(spelled)), np.insert(text, ends, np.arange(len(texts), dtype=np.int32))


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all ``docs``, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for part in parts(batches, "text", STRETCH):
            spelled, index, _ = tokens_of(part.column(0))
            n = np.bincount(index, minlength=len(spelled))
            held.append(pa.table({"word": spelled.filter(pa.array(n > 0)), "n": pa.array(n[n > 0])}))
            rows += len(held[-1])
            if rows > 2 * HELD:
                held = [added()]
                rows = len(held[0])
                if rows > HELD:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from added().to_batches()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Frequent words with class and count, found by a 128-bit hash of theirs; the totals of all words and of each class.

    The first words are classes of their own, the others share classes by their last bytes. ``shared``: for each of
    these, the sum of counts and the number of words, the single ones included.
    """

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, classes: int, shared: dict[int, tuple[int, int]]):
        self.total, self.distinct, self.classes, self.single = total, distinct, classes, classes // 2
        count = dict(zip(words, counts, strict=True))
        words = [END, *(w for w in words if w != END)]
        count.setdefault(END, 0)
        hashes = self._hashes(words)
        self.order = np.argsort(hashes[:, 0], kind="stable").astype(np.int32)
        self.high, self.low = hashes[self.order, 0], hashes[self.order, 1]
        if len(self.high) > 1 and (self.high[1:] == self.high[:-1]).any():
            raise ValueError("two remembered words share the first half of their hash")
        n = np.array([count[w] for w in words], dtype=np.float64)
        self.known, self.log_count = n > 0, np.log10(n + 0.1)
        totals, distinct_in = np.zeros(classes), np.zeros(classes)
        for c, (a, b) in shared.items():
            totals[self.single + c], distinct_in[self.single + c] = a, b
        for k, w in enumerate(words[: self.single]):
            totals[k] = count[w]
            if count[w]:
                totals[self.single + self.suffix(w)] -= count[w]
                distinct_in[self.single + self.suffix(w)] -= 1
        self.class_counts, self.class_log = totals.clip(0), np.log10(totals + 0.1 * (distinct_in + 1))

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").reshape(-1, 2).astype(np.uint64)

    def suffix(self, word: bytes) -> int:
        return zlib.crc32(word[-3:]) % (self.classes - self.single)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word among the frequent ones (-1: beyond) and its class."""
        hashes = self._hashes(words)
        at = np.searchsorted(self.high, hashes[:, 0]).clip(max=len(self.high) - 1)
        place = np.where((self.high[at] == hashes[:, 0]) & (self.low[at] == hashes[:, 1]), self.order[at], -1)
        cls = np.fromiter(map(self.suffix, words), dtype=np.int32, count=len(words)) + self.single
        return place, np.where((place >= 0) & (place < self.single), place, cls).astype(np.int32)

    @property
    def base_log(self) -> float:
        return log10(self.total + 0.1 * (self.distinct + 1))


def lexicon(counts: DataFrame) -> Lexicon:
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    classes = min(MOST, max(FEWEST, isqrt(totals["v"]) // 2 * 2))
    # the words of the upper bins of their counts, as many bins as are remembered; no sort gathers words in a task
    bin_ = F.floor(F.log2("n") * 8)
    bins, kept, lowest = counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("words")).collect(), 0, None
    for r in sorted(bins, key=lambda r: -r["b"]):
        kept += r["words"]
        if kept > REMEMBERED:
            break
        lowest = r["b"]
    top = counts.where(bin_ >= lowest if lowest is not None else F.lit(False)).toArrow()
    words, n = [bytes(w) for w in top["word"].to_pylist()], top["n"].to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    of = F.crc32(F.when(F.octet_length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))) % (classes - classes // 2)
    shared = {r["c"]: (r["n"], r["v"]) for r in counts.groupBy(of.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    return Lexicon([words[i] for i in order], [n[i] for i in order], totals["n"], totals["v"], classes, shared)


class Coded:
    """Texts as arrays over all their tokens: class, the two classes before, place among the frequent words (-1: beyond), text."""

    def __init__(self, texts: pa.Array, lex: Lexicon):
        self.spelled, self.ids, self.of = tokens_of(texts)
        place, cls = lex.find(self.spelled.to_pylist())
        self.place, self.cls = place[self.ids], cls[self.ids]
        self.sizes = np.bincount(self.of, minlength=len(texts))
        first = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate((self.cls[:1], self.cls[:-1]))
        self.before2 = np.concatenate((self.cls[:2], self.cls[:-2]))[: len(self.cls)]
        # before a text stands the end of another
        self.before[first] = self.before2[first] = 0
        second = first[self.sizes > 1] + 1
        self.before2[second] = 0


class Model:
    """Context vectors r, target vectors q with the bias as a last column, and the scale c of each context place."""

    def __init__(self, counts: np.ndarray):
        rng, n = np.random.default_rng(17), len(counts)
        self.noise = (counts + 0.1) / (counts.sum() + 0.1 * n)
        q = np.concatenate((rng.normal(0, 0.1, (n, WIDTH)), np.log(self.noise)[:, None]), axis=1)
        self.p = {"r": rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32), "q": q.astype(np.float32), "c": np.ones((2, WIDTH), dtype=np.float32)}

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a1[target, before], a2[target, before2] with the bias in a1, and the log normaliser of every (before, before2)."""
        r, q, c = (self.p[k].astype(np.float64) for k in "rqc")
        a1, a2 = (q[:, :-1] * c[0]) @ r.T + q[:, -1:], (q[:, :-1] * c[1]) @ r.T
        m1, m2 = a1.max(axis=0), a2.max(axis=0)
        z = np.exp(a1 - m1).T @ np.exp(a2 - m2)
        return a1.astype(np.float32), a2.astype(np.float32), (np.log(z) + m1[:, None] + m2[None, :]).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation by Adagrad, with noise shared in a batch; a step touches the rows of its own classes only."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        self.rng, self.tokens = np.random.default_rng(seed), 0
        self.steps = np.cumsum(noise)

    @property
    def batch(self) -> int:
        """Tokens of the next step: a share of those seen, so that steps are short at first."""
        return min(BATCHES[1], max(BATCHES[0], self.tokens // 64))

    def _climb(self, k: str, at: np.ndarray, rows: np.ndarray) -> None:
        """Adds up the gradients of equal rows and takes a step along each."""
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        own, g = ordered[first], np.add.reduceat(rows[order], first, axis=0)
        seen = self.seen[k][own] + g * g
        self.seen[k][own] = seen
        self.p[k][own] += np.float32(RATE) * g / np.sqrt(seen)

    def step(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        p, n = self.p, np.float32(len(w))
        r1, r2, c = p["r"][h1], p["r"][h2], p["c"]
        hidden = np.ones((len(w), WIDTH + 1), dtype=np.float32)
        hidden[:, :-1] = r1 * c[0] + r2 * c[1]
        noise = np.searchsorted(self.steps, self.rng.random(NOISE) * self.steps[-1]).clip(0, len(self.steps) - 1)
        qw, qn = p["q"][w], p["q"][noise]
        data = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", hidden, qw) - self.log_noise[w], -30, 30))) / n
        fake = -1 / (1 + np.exp(np.clip(self.log_noise[noise] - hidden @ qn.T, -30, 30))) / n
        dh = (data[:, None] * qw + fake @ qn)[:, :-1]
        scale = np.stack([np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2)])
        self._climb("q", np.concatenate((w, noise)), np.concatenate((data[:, None] * hidden, fake.T @ hidden)))
        self._climb("r", np.concatenate((h1, h2)), np.concatenate((dh * c[0], dh * c[1])))
        self.seen["c"] += scale * scale
        p["c"] += np.float32(RATE / 10) * scale / np.sqrt(self.seen["c"])
        self.tokens += len(w)


def train(docs: DataFrame, lex: Lexicon, shared: Broadcast, text: str = "text", seed_column: str = "doc_id") -> Model:
    """The model after all rounds over ``docs``; ``shared`` holds ``lex``."""
    model, context = Model(lex.class_counts), docs.sparkSession.sparkContext
    for k, (low, high) in enumerate(ROUNDS):
        start = context.broadcast((model.p, model.noise))
        share = F.pmod(F.xxhash64(F.lit("round"), seed_column, text), F.lit(100))

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            trainer = Trainer(*start.value, seed=1000 * k + part)
            for texts in parts(batches, "text", STRETCH):
                x = Coded(texts.column(0), shared.value)
                order = np.random.default_rng(part).permutation(len(x.cls))
                at = 0
                while at < len(order):
                    i = order[at : at + trainer.batch]
                    trainer.step(x.cls[i], x.before[i], x.before2[i])
                    at += len(i)
            if trainer.tokens:
                flat = np.concatenate([v.ravel() for v in trainer.p.values()]).astype("<f8") * trainer.tokens
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "tokens", "sums"])

        def added(t: pa.Table) -> pa.Table:
            t = t.sort_by("part")
            total = sum(np.frombuffer(x.as_py(), dtype="<f8") for x in t["sums"])
            return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "tokens": pa.array([sum(t["tokens"].to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        some = docs.where((share >= low) & (share < high)).select(F.col(text).alias("text"))
        own = written(some.mapInArrow(run, "part int, tokens long, sums binary"), "params")
        groups = max(1, isqrt(own.count()))
        sums = own.groupBy((F.col("part") % groups).alias("g")).applyInArrow(added, "part int, tokens long, sums binary").toArrow().sort_by("part")
        n = sum(sums["tokens"].to_pylist())
        if n:
            model.load(sum(np.frombuffer(x.as_py(), dtype="<f8") for x in sums["sums"]) / n)
        start.destroy()
    return model


PARTIAL = "doc_id {id}, held_out boolean, n_tokens long, n_known long, logs double, chain double, within double, beyond array<binary>"


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, shared: Broadcast, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; ``counts``: a written table."""
    tables = docs.sparkSession.sparkContext.broadcast(model.tables())
    names = [x.split()[0] for x in PARTIAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, (a1, a2, norm) = shared.value, tables.value
        for part in parts(batches, "text", STRETCH):
            x = Coded(part.column(2), lex)
            n = part.num_rows
            total = lambda v: np.bincount(x.of, weights=v, minlength=n)
            near = x.place >= 0
            logs = np.where(near, lex.log_count[x.place], 0)
            chain = total(a1[x.cls, x.before] + a2[x.cls, x.before2] - norm[x.before, x.before2]) / np.log(10)
            within = np.where(x.cls >= lex.single, logs - lex.class_log[x.cls], 0)
            far = np.flatnonzero(~near)
            starts = np.searchsorted(far, np.concatenate(([0], np.cumsum(x.sizes))))
            beyond = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x.spelled.take(pa.array(x.ids[far])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x.sizes), pa.array(total(near & lex.known[x.place]).astype(np.int64)), pa.array(total(logs)), pa.array(chain), pa.array(total(within)), beyond], names)

    base = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    partial = written(base.mapInArrow(run, PARTIAL.format(id=dict(docs.dtypes)[doc_id])).withColumn("row", F.monotonically_increasing_id()), "partial")
    tokens = partial.select("row", F.explode("beyond").alias("word"))
    found = tokens.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.count("n").alias("more_known"))
    joined = partial.drop("beyond").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(lex.base_log)).alias("base_score"), (F.col("chain") + F.col("within") + more).alias("score"),
    )


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, model and scores of ``docs``: all steps in order."""
    training = docs.where(~held_out(F.col(doc_id)))
    counts = written(count_tokens(training, text), "counts")
    lex = lexicon(counts)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    return score(docs, counts, lex, shared, train(training, lex, shared, text, doc_id), doc_id, text)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
