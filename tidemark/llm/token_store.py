"""Token-id output as ORC.

Documents are range-partitioned and sorted by id, encoded, and written as ORC: token ids are integer
run-length encoded in stripes, with a row index and a Bloom filter on the document id, so that readers
take stripes in parallel and skip those that can't hold an id.

Defined cases. Null text: encoded as empty, so its row holds the end id alone. Null doc_id: sorts first.
Repeated rows and equal ids: each row is kept; equal ids are ordered by a hash of the text, then the text.
Empty input: an empty store that reads back as no rows. Columns besides id and text are ignored. A very long text is
encoded whole, in arrays of some ten times its bytes, and is one row of its stripe.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, compress, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parts, scratch, table

STORED = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
#: Distinct words whose ids a worker remembers.
REMEMBERED = 400_000
#: Bytes of text that are encoded at once.
STRETCH = 6 << 20
#: Letters that normalise to themselves and have one lower-case letter each, and visible ASCII.
_PLAIN = r"[\x21-\x7e\u00c0-\u012f\u0131-\u024f]+"
#: The pieces that tokenizers of this kind cut lower-case plain words into, and the line feeds between words.
_PIECES = r"[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|\n"


class WordEncoder:
    """Ids of whole texts, for tokenizers that drop white space, never merge across it and mark the end of each piece.

    Every distinct word is encoded once by the library and remembered, as no id depends on what stands beyond
    the next white space. Plain words are cut into their pieces and encoded many in one text, the marked ends telling
    them apart; other words are encoded one by one.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        # plain pieces are in lower case and apart already
        bare = json.loads(self.tokenizer.to_str())
        if not self.fits(bare):
            raise ValueError("this tokenizer doesn't split at white space and mark the ends of words")
        bare["normalizer"] = None
        bare["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.plain, self.pieces = re.compile(_PLAIN).fullmatch, re.compile(_PIECES).findall
        #: Each word's number; by number, where its ids start, how many they are, and uses. Number 0: the end of a document.
        self._hold([b""], *(np.array([x], dtype=np.int32) for x in (end_id, 0, 1)), np.array([0]))

    @staticmethod
    def fits(spec: dict) -> bool:
        """A tokenizer's description is of the kind that this class can serve."""
        before = spec.get("pre_tokenizer") or {}
        return spec["model"].get("end_of_word_suffix") == "</w>" and before.get("type") == "Sequence" and bool(before.get("pretokenizers"))

    def _hold(self, words: list[bytes], ids: np.ndarray, start: np.ndarray, length: np.ndarray, uses: np.ndarray) -> None:
        self.number: dict[bytes, int] = defaultdict(None, zip(words, range(len(words)), strict=True))
        self.number.default_factory = self.number.__len__
        self.ids, self.start, self.length, self.uses = ids, start, length, uses

    def _gather(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words one after another, and where each word ends."""
        length = self.length[of]
        ends = np.cumsum(length, dtype=np.int32)
        at = np.repeat(self.start[of] - (ends - length), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends

    def _forget(self) -> None:
        """Half of the words stay, those used most."""
        kept = np.sort(np.argsort(-self.uses[1:], kind="stable")[: REMEMBERED // 2] + 1)
        kept = np.concatenate(([0], kept))
        words = list(self.number)
        ids, ends = self._gather(kept)
        length = self.length[kept]
        self._hold([words[i] for i in kept], ids, ends - length, length, self.uses[kept] // 2)

    def _flat(self, plain: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, where in it those of each plain piece and then of each other word start, and how many they are."""
        known = len(self.length)
        at = np.fromiter(map(self.number.get, map(str.encode, plain), repeat(known)), dtype=np.int64, count=len(plain))
        new = list(compress(plain, at >= known))
        # the library's encodings are large, so only their ids outlive a piece of the work; its fast way leaves out the offsets
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *(np.array(self.bare.encode_batch_fast([" ".join(new[i : i + 2000])], add_special_tokens=False)[0].ids, dtype=np.int32) for i in range(0, len(new), 2000))])
        cuts = np.flatnonzero(self.ends[ids])
        if len(cuts) != len(new):
            raise ValueError("the tokenizer doesn't mark the end of each piece once")
        apart = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        sizes, old = np.empty(len(plain) + len(other), dtype=np.int64), np.zeros(len(plain) + len(other), dtype=bool)
        starts = np.empty_like(sizes)
        old[: len(plain)] = at < known
        sizes[old], starts[old] = self.length[at[at < known]], self.start[at[at < known]]
        sizes[~old] = np.concatenate((np.diff(cuts, prepend=-1), np.array([len(x) for x in apart], dtype=np.int64)))
        starts[~old] = len(self.ids) + np.cumsum(sizes[~old]) - sizes[~old]
        return np.concatenate((self.ids, ids, np.array(list(chain.from_iterable(apart)), dtype=np.int32))), starts, sizes

    def learn(self, new: list[bytes]) -> None:
        text = b"\n".join(new).decode("utf-8", "replace")
        texts = text.split("\n")
        words, other = range(len(new)), []
        if "<|" in text or not self.plain(text.replace("\n", "!")):
            is_plain = ["<|" not in t and self.plain(t) is not None for t in texts]
            words = [k for k, x in enumerate(is_plain) if x]
            other = [(k, texts[k]) for k, x in enumerate(is_plain) if not x]
            text = "\n".join(texts[k] for k in words)
        number: dict[str, int] = defaultdict(None, {"\n": 0})
        number.default_factory = number.__len__
        flat = self.pieces(text.lower() + "\n") if len(words) else []
        flat = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        per_word = np.diff(np.flatnonzero(flat == 0), prepend=-1) - 1
        pieces = np.concatenate((flat[flat > 0] - 1, len(number) - 1 + np.arange(len(other))))
        per_word = np.concatenate((per_word, np.ones(len(other), dtype=np.int64)))
        ids, starts, sizes = self._flat(list(islice(number, 1, None)), [t for _, t in other])
        ends = np.cumsum(sizes[pieces])
        at = np.repeat(starts[pieces] - (ends - sizes[pieces]), sizes[pieces]) + np.arange(ends[-1] if len(ends) else 0)
        last = np.concatenate(([0], ends))[np.cumsum(per_word)]
        # back to the order of the new words' numbers
        place = np.fromiter(chain(words, (k for k, _ in other)), dtype=np.int64, count=len(new))
        length, start = np.empty(len(new), dtype=np.int64), np.empty(len(new), dtype=np.int64)
        length[place] = np.diff(last, prepend=0)
        start[place] = len(self.ids) + last - length[place]
        self.start, self.length = np.concatenate((self.start, start.astype(np.int32))), np.concatenate((self.length, length.astype(np.int32)))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), dtype=np.int64)))
        self.ids = np.concatenate((self.ids, ids[at]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each ended by the end id, and how many each text has.

        Arrow splits the texts at ASCII white space and finds the distinct words of this stretch; only these are looked up.
        """
        if len(self.number) > REMEMBERED:
            self._forget()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        of = words.flatten().dictionary_encode()
        # to_pylist would make a scalar of each word first
        index, spelled = of.indices.to_numpy(), of.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.number.__getitem__, spelled), dtype=np.int32, count=len(spelled))
        if len(self.number) > len(self.length):
            self.learn(list(islice(self.number, len(self.length), None)))
        # number 0 stands for the empty strings that lead and trail, and here for none of them but the last
        seq = number[index]
        real = seq > 0
        before = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(real, dtype=np.int32)))
        ends = before[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        ended = np.insert(seq[real], ends, 0)
        self.uses += np.bincount(ended, minlength=len(self.uses))
        ids, ends_of = self._gather(ended)
        return ids, np.diff(ends_of[ends + np.arange(len(ends))], prepend=0).astype(np.int64)


class TextEncoder:
    """Ids of whole texts by the library alone, for tokenizers of any kind."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in (*ids, self.end_id)], dtype=np.int32), np.array([len(ids) + 1 for ids in found], dtype=np.int64)


def word_encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    """The worker's own encoder, kept from task to task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if (path, end_id) not in kept:
        with open(path, encoding="utf-8") as f:
            kept[path, end_id] = (WordEncoder if WordEncoder.fits(json.load(f)) else TextEncoder)(path, end_id)
    return kept[path, end_id]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", stripe_mb: int = 64) -> None:
    """Encodes whole texts and writes them to ``path`` in ascending order of the id, one sorted ORC file per range."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = word_encoder(tokenizer, end_id), 0
        for part in parts(batches, "text", STRETCH):
            ids, sizes = encoder.encode(part.column(1).cast(pa.string()))
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(start + ends - sizes), pa.array(sizes), lists], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
            start += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*order)
    rows = ranges.sortWithinPartitions(*order, "text").withColumn("shard", F.spark_partition_id())
    rows.mapInArrow(encode, STORED).write.options(
        **{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_mb << 20)}
    ).orc(path)


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard, summed from one integer column: a number a file."""
    totals = spark.read.schema(STORED).orc(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    ordered = sorted((r["shard"], r["n"]) for r in totals)
    return dict(zip((s for s, _ in ordered), accumulate((n for _, n in ordered), initial=0), strict=False))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, from the files alone. A row for each file is broadcast."""
    base = spark.createDataFrame(list(_bases(spark, path).items()), "shard int, base long")
    return spark.read.schema(STORED).orc(path).join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


CHECKED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _checked(doc_id: pa.Array, start: pa.Array, n_tokens: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    sums = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([doc_id, start, n_tokens, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _checked(*b.columns)

    return tokens.mapInArrow(crc, CHECKED)


def stored_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``checksums`` of a store, whose files are read stripe by stripe where they are summed; the ids don't pass through rows."""
    bases, files = _bases(spark, path), spark.read.schema(STORED).orc(path).inputFiles()
    names = ["doc_id", "shard", "shard_start", "n_tokens", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, orc

        for b in batches:
            for uri in b.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(uri)
                with system.open_input_file(own) as f:
                    stored = orc.ORCFile(f)
                    for k in range(stored.nstripes):
                        stripe = stored.read_stripe(k, names)
                        doc_id, shard, start, n, ids = (stripe.column(c) for c in names)
                        base = np.array([bases[x] for x in shard.to_pylist()], dtype=np.int64)
                        yield _checked(doc_id, pa.array(base + start.to_numpy()), n, ids)

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInArrow(read, CHECKED)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return stored_checksums(spark, path)
