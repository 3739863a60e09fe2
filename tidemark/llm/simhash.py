"""SimHash near-duplicates with vantage-point trees.

A fingerprint has a bit set where over half of a text's shingle hashes have it; equal fingerprints are one
node. A tree over the nodes is fitted on a bounded sample: each branch splits by Hamming distance from a
vantage point (or, where sizes must agree, by size), chosen for the fewest nodes within reach of the
boundary. Every node is routed to the shard of its own side, and as a guest to each shard that the triangle
bound leaves within reach; there are about ``SHARDS`` of them at any size. A shard too large
for a task is dealt by chunks: of two fingerprints within ``radius`` bits, cut into one chunk more than that, a chunk
is equal. Where that can't be (a wide radius), or a chunk is common, it is dealt to pairs of parts, so no task holds
more than two parts. Within a task only pairs with an equal chunk are compared, or else a tree and blocks of distances
are searched. A task returns a forest of its links, not all pairs, and the forests' connected components are the groups.

``drop_near_duplicates`` only takes candidates from this: what the components of a wide radius hold is compared again by
the distinct shingles themselves, and only pairs at the similarity or above are links.

Defined cases. Null text: no words. No words: fingerprint zero, a node like any other. Fewer words than a
shingle: the whole sequence. Repeated rows and equal texts share a node. Null id: grouped by text, never the
name of a group unless no member has an id. Empty table: no rows. Further columns are ignored, or kept by
``drop_near_duplicates``. A very long text is read whole, its words and shingles as lists of some hundred bytes a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_broadcast, slices, table, written
from tidemark.llm.components import components

#: Bytes of a node before its fingerprint: the number of distinct shingles, or zero where sizes don't count.
SIZE = 4
#: Nodes that the tree is fitted on; the only use of this sample is where the tree's branches lie.
SAMPLE = 8192
#: Shards of a tree: as many at any size, so that guests grow as the nodes do; large shards are dealt further.
SHARDS = 8
#: Pairs that are compared at once.
PAIRS = 1 << 20


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every shingle, repeats included."""
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined, ends = b" ".join(words), list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [xxhash.xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts, ends[width - 1 :], strict=False)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits from a hash; k = 0: the hash itself."""
    if not k:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints_of(hashes: list[list[int]], words: int) -> np.ndarray:
    """(texts, 8 * words) bytes, most significant bit first."""
    n = np.array([len(x) for x in hashes])
    out = np.zeros((len(hashes), 8 * words), dtype=np.uint8)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    flat = np.array([h for x in hashes for h in x], dtype=np.uint64)
    ends = np.cumsum(n[some])
    firsts = np.concatenate(([0], ends[:-1]))
    # stretches of at most 255 hashes, whose bits add up in bytes
    cuts = np.unique(np.concatenate([np.arange(a, z, 255) for a, z in zip(firsts, ends, strict=True)]))
    of = np.searchsorted(cuts, firsts)
    for k in range(words):
        counts = []
        for at in range(0, len(cuts), 4096):
            part = cuts[at : at + 4096]
            end = cuts[at + 4096] if at + 4096 < len(cuts) else len(flat)
            bits = np.unpackbits(_mixed(flat[part[0] : end], k).astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
            counts.append(np.add.reduceat(bits, part - part[0], axis=0).view(np.uint8).reshape(-1, 64))
        ones = np.add.reduceat(np.concatenate(counts).astype(np.int64), of, axis=0)
        out[some, 8 * k : 8 * k + 8] = np.packbits(ones * 2 > n[some, None], axis=1)
    return out


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, sized: bool = False, text: str = "text") -> DataFrame:
    """``docs`` without the text and with ``node``: size and fingerprint as bytes. ``sized``: of the distinct shingles, with their number and a further column ``digest`` of them."""
    kept = [c for c in docs.columns if c not in (text, "node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            hashes = [shingle_hashes(x or b"", width) for x in texts]
            if sized:
                hashes = [sorted(set(h)) for h in hashes]
            sizes = [len(h) if sized else 0 for h in hashes]
            nodes = [s.to_bytes(SIZE, "big") + f.tobytes() for s, f in zip(sizes, fingerprints_of(hashes, words), strict=True)]
            made = [pa.array(nodes, pa.binary())]
            if sized:
                made.append(pa.array([xxhash.xxh3_128_digest(np.array(h, dtype=np.uint64).tobytes()) for h in hashes], pa.binary()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], [*kept, *names])

    names = ["node", "digest"] if sized else ["node"]
    schema = docs.select(*kept, *[F.lit(b"").cast("binary").alias(c) for c in names]).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def unpacked(nodes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the sizes, and fingerprints as (n, words) 64-bit integers."""
    raw = np.frombuffer(b"".join(nodes), dtype=np.uint8).reshape(len(nodes), -1)
    sizes = raw[:, :SIZE].copy().view(">u4")[:, 0].astype(np.float64)
    return np.log(np.maximum(sizes, 0.5)), raw[:, SIZE:].copy().view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    if a.shape[1] > 1:
        total = total.astype(np.uint16)
        for k in range(1, a.shape[1]):
            total += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return total


def fit_tree(nodes: list[bytes], count: int, radius: int, reach: float, leaf: int) -> dict:
    """Branches until a shard is estimated to own at most ``leaf`` nodes, or no split keeps apart enough of them."""
    sizes, prints = unpacked(nodes)
    shards = iter(range(1 << 30))

    def grow(at: np.ndarray) -> dict:
        if len(at) < 64 or count * len(at) / len(nodes) <= leaf:
            return {"shard": next(shards)}
        tries = []
        if math.isfinite(reach):
            mid = float(np.median(sizes[at]))
            tries.append((np.mean(np.abs(sizes[at] - mid) <= reach), {"size": mid}, sizes[at] <= mid))
        for v in at[:: max(1, len(at) // 12)][:12]:
            d = distances(prints[at], prints[v : v + 1])[:, 0].astype(int)
            mid = int(np.median(d))
            tries.append((np.mean(np.abs(d - mid) <= radius), {"vantage": prints[v].tolist(), "mid": mid}, d <= mid))
        near, branch, inside = min((t for t in tries if 0.2 < t[2].mean() < 0.8), key=lambda t: t[0], default=(1, None, None))
        if near > 0.75:
            return {"shard": next(shards)}
        return branch | {"in": grow(at[inside]), "out": grow(at[~inside])}

    return grow(np.arange(len(nodes)))


def route(tree: dict, sizes: np.ndarray, prints: np.ndarray, radius: int, reach: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions, own): each node once as its own, and as a guest wherever a node within reach may be."""
    found = []

    def walk(node: dict, at: np.ndarray, own: np.ndarray) -> None:
        if not len(at):
            return
        if "shard" in node:
            found.append((node["shard"], at, own))
            return
        if "size" in node:
            d, mid, r = sizes[at], node["size"], reach
        else:
            d, mid, r = distances(prints[at], np.array([node["vantage"]], dtype=np.uint64))[:, 0].astype(int), node["mid"], radius
        inside = d <= mid
        to = d <= mid + r
        walk(node["in"], at[to], (own & inside)[to])
        to = d > mid - r - 1e-12
        walk(node["out"], at[to], (own & ~inside)[to])

    walk(tree, np.arange(len(sizes)), np.ones(len(sizes), dtype=bool))
    return found


class Forest:
    """Union of links between positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


def chunks_of(radius: int, words: int) -> int:
    """How many chunks of whole bytes a fingerprint of 64 bits is cut into, one more than may differ; 0 if that isn't possible."""
    return radius + 1 if words == 1 and 8 % (radius + 1) == 0 else 0


def pairs_within(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with a[i] == b[j], some ``PAIRS`` at a time."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    ordered = b[order_b]
    low = np.searchsorted(ordered, a[order_a], "left")
    n = np.searchsorted(ordered, a[order_a], "right") - low
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at] - n[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        m = n[at:to]
        within = np.arange(m.sum()) - np.repeat(ends[at:to] - m - base, m)
        yield np.repeat(order_a[at:to], m), order_b[np.repeat(low[at:to], m) + within]
        at = to


def search_chunks(own: np.ndarray, all_: np.ndarray, prints: np.ndarray, radius: int, forest: Forest) -> bool:
    """Links as ``search`` does, by the pairs that share a chunk; False, and nothing done, if those are many of all pairs."""
    count = chunks_of(radius, prints.shape[1])
    if not count:
        return False
    bits = 64 // count
    keys = [((prints[x, 0] >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(count) for x in (own, all_)]
    expected = sum(float(np.bincount(a, minlength=1 << bits) @ np.bincount(b, minlength=1 << bits).astype(np.float64)) for a, b in zip(keys[::2], keys[1::2], strict=True)) if bits <= 16 else 0
    if expected > 0.25 * len(own) * len(all_):
        return False
    for a, b in zip(keys[::2], keys[1::2], strict=True):
        for i, j in pairs_within(a, b):
            near = np.bitwise_count(prints[own[i], 0] ^ prints[all_[j], 0]) <= radius
            forest.link(own[i[near]], all_[j[near]])
    return True


def search(own: np.ndarray, all_: np.ndarray, sizes: np.ndarray, prints: np.ndarray, radius: int, reach: float, forest: Forest) -> None:
    """Links every position in ``own`` with those of ``all_`` within the radius (and size reach): a tree, and blocks at its leaves."""
    if not len(own) or not len(all_):
        return
    if not math.isfinite(reach) and len(own) > 256 and search_chunks(own, all_, prints, radius, forest):
        return
    if len(own) > 256 and len(all_) > 256:
        vantage = own[len(own) // 2]
        da, db = (distances(prints[x], prints[vantage : vantage + 1])[:, 0].astype(int) for x in (own, all_))
        mid = int(np.median(da))
        inside, to_in, to_out = da <= mid, db <= mid + radius, db > mid - radius
        if 0.1 < inside.mean() < 0.9 and to_in.sum() * inside.sum() + to_out.sum() * (~inside).sum() < 0.85 * len(own) * len(all_):
            search(own[inside], all_[to_in], sizes, prints, radius, reach, forest)
            search(own[~inside], all_[to_out], sizes, prints, radius, reach, forest)
            return
    own, all_ = own[np.argsort(sizes[own], kind="stable")], all_[np.argsort(sizes[all_], kind="stable")]
    ordered = sizes[all_]
    for i in range(0, len(own), 512):
        a = own[i : i + 512]
        low, high = np.searchsorted(ordered, sizes[a[0]] - reach, "left"), np.searchsorted(ordered, sizes[a[-1]] + reach, "right")
        for j in range(low, high, 2048):
            b = all_[j : min(j + 2048, high)]
            x, y = np.nonzero(distances(prints[a], prints[b]) <= radius)
            if len(x) and math.isfinite(reach):
                fit = np.abs(sizes[a[x]] - sizes[b[y]]) <= reach + 1e-9
                x, y = x[fit], y[fit]
            forest.link(a[x], b[y])


def near_links(nodes: DataFrame, radius: int, ratio: float = 0.0, leaf: int = 1024, part: int = 262_144) -> DataFrame:
    """(a, b): links whose components are those of all pairs of nodes within ``radius`` bits and with sizes in ``ratio`` (0: any)."""
    reach = math.log(1 / ratio) + 1e-9 if ratio else math.inf
    count = nodes.count()
    sample = [bytes(r["node"]) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()]
    chunks = chunks_of(radius, (len(sample[0]) - SIZE) // 8) if sample and not ratio else 0
    tree = fit_tree(sample, count, radius, reach, max(leaf, -(-count // SHARDS))) if sample else {"shard": 0}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for shard, at, own in route(tree, *unpacked(b.column(0).to_pylist()), radius, reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, dtype=np.int32)), b.column(0).take(pa.array(at)), pa.array(own)], ["shard", "node", "own"])

    dealt = written(nodes.select("node").mapInArrow(deal, "shard int, node binary, own boolean"), "shards")
    key = ["shard", "chunk", "slot"]
    parts_of = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / part).cast("int").alias("parts"))
    whole = dealt.withColumns({"chunk": F.lit(0), "slot": F.lit(0)})
    if chunks:
        # a row a shard, of which there are few
        width, large = 8 // chunks, F.col("parts") > 1
        at = F.explode(F.when(large, F.sequence(F.lit(0), F.lit(chunks - 1))).otherwise(F.array(F.lit(0))))
        cut = dealt.join(F.broadcast(parts_of(dealt, ["shard"])), "shard").withColumn("chunk", at)
        slot = F.when(large, F.pmod(F.xxhash64(F.expr(f"substring(node, {SIZE + 1} + chunk * {width}, {width})")), F.col("parts") * 2).cast("int")).otherwise(0)
        whole = cut.withColumn("slot", slot).drop("parts")
    sizes = written(parts_of(whole, key), "sizes")
    own_part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a group of P parts is searched as pairs of parts: each node goes to the P pairs that hold its part
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sized = whole.join(maybe_broadcast(sizes, sizes.count(), 100_000), key)
    paired = sized.withColumn("mine", own_part).withColumn("other", other).select(*key, F.least("mine", "other").cast("int").alias("i"), F.greatest("mine", "other").cast("int").alias("j"), "mine", "node", "own")

    def join(t: pa.Table) -> pa.Table:
        names = t.column("node").to_pylist()
        logs, prints = unpacked(names)
        own, mine = t.column("own").to_numpy(zero_copy_only=False), t.column("mine").to_numpy()
        i, j, forest = t.column("i")[0].as_py(), t.column("j")[0].as_py(), Forest(len(names))
        for x, y in {(i, j), (j, i)}:
            search(np.flatnonzero(own & (mine == x)), np.flatnonzero(mine == y), logs, prints, radius, reach, forest)
        tied = np.flatnonzero(forest.parent != np.arange(len(names)))
        return pa.table({"a": pa.array([names[k] for k in tied], pa.binary()), "b": pa.array([names[k] for k in forest.parent[tied]], pa.binary())})

    return paired.groupBy(*key, "i", "j").applyInArrow(join, "a binary, b binary")


def groups(prints: DataFrame, radius: int, ratio: float = 0.0, doc_id: str = "doc_id") -> DataFrame:
    """(node, group, component_id): for each node the name and the least id of its group. ``prints``: a written table of ids and nodes."""
    nodes = written(prints.groupBy("node").agg(F.min(doc_id).alias("least")), "nodes")
    member = written(components(near_links(nodes, radius, ratio), "a", "b"), "members")
    named = nodes.join(member, "node")
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "groups")
    linked = written(member.join(ids, "component"), "linked")
    return written(nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "least").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the least id reachable over links of ``radius`` bits at most."""
    prints = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width), "prints")
    of = groups(prints, radius)
    return prints.join(of, "node").select("doc_id", F.lower(F.hex(F.substring("node", SIZE + 1, 8))).alias("fingerprint"), "component_id")


#: For ``drop_near_duplicates``: texts are similar when their distinct shingles have this Jaccard similarity (as a fraction).
SIMILAR = (4, 5)
#: Candidates: 256 bits, at most this many that differ, and sizes that allow the similarity. At a similarity of 0.8 about
#: 38.8 bits differ, with a deviation of 5.7, so 64 is 4.4 deviations beyond.
WIDE_WORDS, WIDE_RADIUS, WIDE_RATIO = 4, 64, 0.8


def shingle_sets(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``docs`` with ``hashes``, the distinct shingle hashes in order as bytes, instead of the text."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            sets = [np.unique(np.array(shingle_hashes(x or b"", width), dtype=np.uint64)).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(sets, pa.binary())], [*kept, "hashes"])

    schema = docs.select(*kept, F.lit(b"").cast("binary").alias("hashes")).schema
    return docs.mapInArrow(run, schema)


class SimilarForest(Forest):
    """Links only pairs whose sets are similar. Pairs that are tied already, and of ``twice`` seen pairs the second, need no look."""

    def __init__(self, sets: list[np.ndarray], twice: bool):
        super().__init__(len(sets))
        self.sets, self.twice = sets, twice

    def similar(self, a: int, b: int) -> bool:
        both = np.concatenate((self.sets[a], self.sets[b]))
        both.sort()
        common = np.count_nonzero(both[1:] == both[:-1])
        return SIMILAR[1] * common >= SIMILAR[0] * (len(both) - common)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.twice:
            a, b = a[a < b], b[a < b]
        step = 256
        while True:
            untied = self.parent[a] != self.parent[b]
            a, b = a[untied], b[untied]
            if not len(a):
                return
            x, y = a[:step], b[:step]
            fit = np.fromiter((self.similar(i, j) for i, j in zip(x, y, strict=True)), dtype=bool, count=len(x))
            super().link(x[fit], y[fit])
            a, b, step = a[step:], b[step:], 2 * step


def similar_links(sets: DataFrame, radius: int, ratio: float, part: int = 16 << 20) -> DataFrame:
    """(a, b): links whose components are those of all similar pairs within a cluster, ``radius`` and ``ratio``.

    ``sets``: a written table of key, node, cluster, hashes. Clusters share buckets; a bucket of over ``part`` bytes is dealt
    to pairs of parts, as shards are.
    """
    reach = math.log(1 / ratio) + 1e-9
    total = sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    dealt = sets.withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(max(1, 2 * total // part))).cast("int"))
    parts = F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("hashes")) / part)).cast("int").alias("parts")
    own_part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = dealt.join(F.broadcast(dealt.groupBy("bucket").agg(parts)), "bucket").withColumn("mine", own_part).withColumn("other", other).select("bucket", F.least("mine", "other").cast("int").alias("i"), F.greatest("mine", "other").cast("int").alias("j"), "mine", "key", "node", "hashes")

    def join(t: pa.Table) -> pa.Table:
        keys, mine = t.column("key").to_pylist(), t.column("mine").to_numpy()
        logs, prints = unpacked(t.column("node").to_pylist())
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        forest = SimilarForest([np.frombuffer(x, dtype=np.uint64) for x in t.column("hashes").to_pylist()], i == j)
        search(np.flatnonzero(mine == i), np.flatnonzero(mine == j), logs, prints, radius, reach, forest)
        tied = np.flatnonzero(forest.parent != np.arange(len(keys)))
        return pa.table({"a": pa.array([keys[k] for k in tied], pa.binary()), "b": pa.array([keys[k] for k in forest.parent[tied]], pa.binary())})

    return paired.groupBy("bucket", "i", "j").applyInArrow(join, "a binary, b binary")


def drop_near_duplicates(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of texts whose distinct five-word shingles are similar by 0.8 or more: that with the least id.

    Candidates are read from wide fingerprints, links from the shingles. Of rows with equal ids, and of those without, one row stays by its place.
    """
    rows = docs.select(F.struct(*docs.columns).alias("r"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    held = written(fingerprints(rows, width, WIDE_WORDS, sized=True), "prints")
    prints = held.select("doc_id", "row", "node", F.concat("node", "digest").alias("key"))
    # texts of equal shingles share a key; keys of one fingerprint, or of fingerprints that candidates tie, a cluster
    keys = written(prints.groupBy("node", "key").agg(F.min("row").alias("row")), "keys")
    nodes = written(keys.select("node").distinct(), "nodes")
    near = written(components(near_links(nodes, WIDE_RADIUS, WIDE_RATIO), "a", "b"), "near")
    placed = written(keys.join(near, "node", "left").select("row", "key", F.coalesce("component", "node").alias("cluster")), "placed")
    shared = placed.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    candidates = written(placed.join(shared, "cluster"), "candidates")
    picked = held.select("row", "node", F.col("r")[text].alias("text")).join(maybe_broadcast(candidates, candidates.count(), 100_000), "row")
    sets = written(shingle_sets(picked.select("key", "node", "cluster", "text"), width), "sets")
    similar = written(components(similar_links(sets, WIDE_RADIUS, WIDE_RATIO), "a", "b").select(F.col("node").alias("key"), "component"), "similar")
    member = prints.join(similar, "key", "left").select("doc_id", "row", F.coalesce("component", "key").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    several = written(member.groupBy("group").agg(first.alias("kept"), F.count("*").alias("n")).where("n > 1").select("group", "kept"), "several")
    dropped = written(member.join(several, "group").where("row <> kept").select("row"), "dropped")
    return held.join(maybe_broadcast(dropped, dropped.count(), 1_000_000), "row", "left_anti").select("r.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
