"""Byte-level BPE by merge replay over a corpus, and its inverse.

Texts are cut by a pattern; the distinct pieces of a stretch of the corpus are laid out as one array of tokens
with links to their neighbours. An inverted index from token pair to positions then gives, in the order of the
ranks, every place where a merge applies; each merge touches its neighbours only, whose new pairs enter the
index. Each distinct piece is thus merged once for all texts of the stretch, and texts are its ids in order.

Stretches are bounded by bytes, so memory is too; a text longer than that is a stretch of its own. No shuffle.

Defined cases. Null text: as empty, which has no ids. Repeated rows: each is encoded. Equal ranks: from left
to right. No rows: no rows. Further columns are ignored by ``encode``, which returns its own.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

STRETCH = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a pool one after another, and where each ends."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Merges:
    """Ranks of token pairs: the rank of a pair is that of the bytes that it spells."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.spelled = ranks, {v: k for k, v in ranks.items()}
        self.one = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[int, int] = {}

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Ranks of coded pairs; -1: no merge."""
        out = np.empty(len(codes), dtype=np.int64)
        for k, code in enumerate(codes.tolist()):
            if code not in self.known:
                self.known[code] = self.ranks.get(self.spelled[code >> 24] + self.spelled[code & 0xFFFFFF], -1)
            out[k] = self.known[code]
        return out


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the (non-empty) pieces one after another, and how many each has: all merges over all pieces, in rank order."""
    token = merges.one[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    ends = np.cumsum([len(p) for p in pieces])
    after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
    after[ends - 1], before[np.concatenate(([0], ends[:-1]))] = -1, -1
    places: dict[int, list[np.ndarray]] = {}
    pairs: dict[int, set[int]] = defaultdict(set)
    queue: list[int] = []

    def note(at: np.ndarray) -> None:
        """Enters the pairs that begin at these places into the index."""
        if not len(at):
            return
        codes, of = np.unique((token[at] << 24) | token[after[at]], return_inverse=True)
        ranks = merges.of(codes)
        for code, r in zip(codes[ranks >= 0].tolist(), ranks[ranks >= 0].tolist(), strict=True):
            pairs[r].add(code)
        rank = ranks[of]
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, some in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=True) if len(at) else ():
            if r not in places:
                places[r] = []
                heappush(queue, r)
            places[r].append(some)

    note(np.flatnonzero(after >= 0))
    while queue:
        r = heappop(queue)
        at = np.unique(np.concatenate(places.pop(r)))
        # a place may have gone, or hold another pair, since it was noted
        at = at[(token[at] >= 0) & (after[at] >= 0)]
        codes = (token[at] << 24) | token[after[at]]
        at = at[np.isin(codes, list(pairs[r]))]
        # of places that follow each other, every second is merged, from the left
        follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
        if follows.any():
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        gone = after[at]
        after[at] = after[gone]
        token[at], token[gone] = r, -1
        next_ = after[at]
        before[next_[next_ >= 0]] = at[next_ >= 0]
        left = before[at]
        note(np.unique(np.concatenate((at[next_ >= 0], left[left >= 0]))))
    kept = token >= 0
    return token[kept].astype(np.int32), np.add.reduceat(kept, np.concatenate(([0], ends[:-1])), dtype=np.int64)


class Encoder:
    """Ids of whole texts.

    White space is the Unicode property, as the library of this file format has it. Texts without two white space
    characters in a row are cut before single spaces first; the pattern never matches across those cuts.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        exact = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces_of = regex.compile(exact).findall
        self.doubled = regex.compile(r"\p{White_Space}\p{White_Space}").search
        self.merges = Merges(ranks)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends."""
        heads, rests = [], []
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        for t in texts:
            head, rest = t, []
            if t and t[0] != " " and t[-1] != " " and not self.doubled(t):
                head, *rest = t.split(" ")
            heads.append(head)
            rests.append(np.fromiter(map(number.__getitem__, rest), dtype=np.int64, count=len(rest)))
        sizes = np.array([len(x) + 1 for x in rests], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        seq = np.empty(int(sizes.sum()), dtype=np.int64)
        is_head = np.zeros(len(seq), dtype=bool)
        is_head[first] = True
        seq[first] = np.arange(len(heads))
        seq[~is_head] = len(heads) + np.concatenate(rests)
        # chunks are cut into pieces, and each distinct piece is merged once
        piece: dict[str, int] = defaultdict()
        piece.default_factory = piece.__len__
        cut, counts = [], []
        for chunk in chain(heads, map(" ".__add__, number)):
            found = self.pieces_of(chunk)
            cut.extend(map(piece.__getitem__, found))
            counts.append(len(found))
        if not piece:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        ids, n = replay([p.encode() for p in piece], self.merges)
        cut, counts = np.array(cut, dtype=np.int64), np.array(counts, dtype=np.int64)
        ids, ends = gather(ids, (np.cumsum(n) - n)[cut], n[cut])
        ends = np.concatenate(([0], ends))[np.cumsum(counts)]
        n = np.diff(ends, prepend=0)
        ids, ends = gather(ids, (ends - n)[seq], n[seq])
        return ids, np.concatenate(([0], ends))[np.cumsum(sizes)]


def lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))


class Decoder:
    """The bytes that ids spell."""

    def __init__(self, ranks: dict[bytes, int]):
        spelled = sorted(ranks, key=ranks.__getitem__)
        at = [ranks[x] for x in spelled]
        self.sizes, self.starts = (np.zeros(max(at) + 1, dtype=np.int64) for _ in range(2))
        self.sizes[at] = [len(x) for x in spelled]
        self.starts[at] = np.cumsum(self.sizes[at]) - self.sizes[at]
        self.pool = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray, rows: int = 200) -> pa.Array:
        """Binary values from ids one after another and where each row's end; ``rows`` of them at a time."""
        out, bounds = [], np.concatenate(([0], ends))
        for k in range(0, len(ends), rows):
            own = bounds[k : k + rows + 1]
            flat = ids[own[0] : own[-1]]
            data, places = gather(self.pool, self.starts[flat], self.sizes[flat])
            offsets = np.concatenate(([0], places))[own - own[0]].astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", stretch: int = STRETCH, decoded: bool = False) -> DataFrame:
    """doc_id, ids of every whole text; with ``decoded`` the ids are decoded too, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        encoder, decoder = Encoder(ranks, pattern), Decoder(ranks)
        for part, texts in slices(batches, "text", stretch):
            ids, ends = encoder.encode([(x or b"").decode("utf-8", "replace") for x in texts])
            columns = [part.column(0), lists(ids, ends), *([decoder.decode(ids, ends)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids of a stored table spell. Null ids spell nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(ranks_path))
        for b in batches:
            counts = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decoder.decode(b.column(1).flatten().to_numpy(), np.cumsum(counts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["doc_id", "ids", "decoded"])

    return tokens.select(F.col(doc_id).alias("doc_id"), "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)[doc_id]}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True))
