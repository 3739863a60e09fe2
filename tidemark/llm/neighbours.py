"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string of bits, signs of random projections, and is a sorted array of these
strings. A query descends each tree to the entries that share its longest prefix, then ascends in all trees at
once, a bit at a time, until they hold enough entries; all those are scored by inner product in double
precision. For inner products, vectors are first lifted by one coordinate to equal length; queries aren't.

Arrays are cut at quantiles of their strings, read from a sample of about ``SAMPLE`` vectors, into blocks of bounded size; a
block that turns out larger is dealt to parts, and the queries that reach it to slices, so that every task holds one part and one
slice. Two passes serve all queries: the first counts the entries at each prefix length, in the query's own block one by one and
beyond it by the totals of the blocks; the second scores the stretch of the prefix that the counts, summed over the
trees, call for, by matrix products, and returns the best of each part. Ids follow only for what is chosen. Equal vectors are one
entry with their smallest ids. How many entries are enough is read, once, from at most ``probes`` queries held against all
vectors. That number is a share of all entries: with it the recall holds at any size, and work grows as the vectors do times that share.

Defined cases. Null vectors, zero vectors and those with null or non-finite components take no part, as query or
candidate. Vectors of another length than a query's are no candidates of it. Equal scores: the smaller id.
Repeated rows with equal ids: the id is found once. Null ids take no part. Fewer candidates than ``k``: all. Empty table: no rows.
Columns of other numbers than floats are taken as doubles. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

TREES, BITS, SEED = 16, 48, 11
#: Bytes of a block's vectors at four a component; vectors that the cuts are read from; blocks of a tree, at most.
BLOCK_BYTES, SAMPLE, MOST_BLOCKS = 8 << 20, 65_536, 4096
#: Scores that a task holds at once.
SCORES = 1 << 21
#: Recall that the probes must show, and the numbers of entries, as shares of all, that are tried for it.
RECALL, SHARES = 0.95, tuple(2.0 ** (k / 4) for k in range(-40, 20))


def planes(dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).standard_normal((TREES, dimension + 1, BITS))


def hashed(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """(trees, n) strings of bits as integers; ``longest``: the length that stored vectors are lifted to, None for queries."""
    lengths = np.linalg.norm(vectors, axis=1)
    if longest is None:
        lifted = np.concatenate([vectors / lengths[:, None], np.zeros((len(vectors), 1))], axis=1)
    else:
        short = vectors / longest
        lifted = np.concatenate([short, np.sqrt(np.maximum(0, 1 - (short**2).sum(axis=1)))[:, None]], axis=1)
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return np.stack([(lifted @ p > 0) @ powers for p in planes(vectors.shape[1])])


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def _packed(v: np.ndarray, kind: str) -> pa.Array:
    """Vectors as bytes, which cost the engine less to move than arrays of numbers."""
    plain = np.ascontiguousarray(v, dtype=np.float32 if kind == "float" else np.float64)
    width = plain.itemsize * plain.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(plain), [None, pa.py_buffer(plain.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.float32 if kind == "float" else np.float64).reshape(len(data), -1).astype(np.float64)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix."""
    _, exponent = np.frexp((a ^ b).astype(np.float64))
    return BITS - exponent


def _smallest(k: int) -> Column:
    return F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)


class Cuts:
    """Where the blocks of each tree end, and how many entries each holds."""

    def __init__(self, ends: dict[tuple[int, int], np.ndarray]):
        self.ends, self.totals = ends, {}

    def of(self, dim: int, tree: int) -> np.ndarray:
        return self.ends.get((dim, tree), np.zeros(0, dtype=np.int64))

    def block(self, dim: int, tree: int, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.of(dim, tree), hashes, "left").astype(np.int32)

    def beyond(self, dim: int, tree: int, hashes: np.ndarray) -> np.ndarray:
        """(n, BITS + 1): entries of the blocks that lie wholly in each prefix of a string, without its own block."""
        total = self.totals[dim, tree]
        edges = np.concatenate(([-1], self.of(dim, tree), [(1 << BITS) - 1]))
        sums, own = np.concatenate(([0], np.cumsum(total))), self.block(dim, tree, hashes)
        out = np.zeros((len(hashes), BITS + 1), dtype=np.int64)
        for bits in range(BITS + 1):
            low = (hashes >> (BITS - bits)) << (BITS - bits)
            first, last = np.searchsorted(edges, low - 1, "left"), np.searchsorted(edges, low + (1 << (BITS - bits)) - 1, "right") - 1
            whole = last > first
            out[:, bits] = np.where(whole, sums[np.maximum(first, last)] - sums[first], 0) - np.where(whole & (first <= own) & (own < last), total[own], 0)
        return out


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of equal ``dim``, at most 4096 at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims):
                yield int(dim), b.take(pa.array(np.flatnonzero(dims == dim)))


def nearest(h: np.ndarray, item: np.ndarray, stored: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, entry, score) of the best ``k`` entries, ties to the smaller item, whose strings are within each query's stretch; ``h`` is sorted."""
    first, last = np.searchsorted(h, low), np.searchsorted(h, high, "right")
    for x, y in np.unique(np.stack((first, last), axis=1), axis=0):
        if x == y:
            continue
        of, kept = np.flatnonzero((first == x) & (last == y)), min(k + 3, y - x)
        for a in range(0, len(of), max(1, SCORES // (y - x))):
            q = of[a : a + max(1, SCORES // (y - x))]
            s = wanted[q] @ stored[x:y].T
            best = np.argpartition(s, y - x - kept, axis=1)[:, -kept:]
            worst = np.take_along_axis(s, best, axis=1).min(axis=1)
            exact = (stored[x + best] * wanted[q][:, None, :]).sum(axis=2)
            order = np.lexsort((item[x + best], -exact), axis=1)[:, :k]
            # of many entries that tie with the last one, the smaller items are wanted
            tied = np.flatnonzero((s >= (worst - 1e-9 * np.maximum(1, np.abs(worst)))[:, None]).sum(axis=1) > kept)
            plain = np.setdiff1d(np.arange(len(q)), tied)
            n = order.shape[1]
            yield np.repeat(q[plain], n), x + np.take_along_axis(best, order, axis=1)[plain].ravel(), np.take_along_axis(exact, order, axis=1)[plain].ravel()
            for i in tied:
                all_ = np.flatnonzero(s[i] >= worst[i] - 1e-9 * max(1, abs(worst[i])))
                own = (stored[x + all_] * wanted[q[i]]).sum(axis=1)
                chosen = np.lexsort((item[x + all_], -own))[:k]
                yield np.repeat(q[i], len(chosen)), x + all_[chosen], own[chosen]


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", probes: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a condition on ``vec_id``) picks, its ``k`` nearest of all other ids."""
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[embedding] == "array<float>" else "double"
    v = F.col("embedding")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding")).where(v.isNotNull() & usable & F.col("vec_id").isNotNull())
    # adding zero makes one of the two zeros
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)).alias("embedding"), is_query.alias("asks"))
    # equal vectors: first their smallest ids within salts, then over them, so no task gathers a large group
    salted = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(_smallest(k).alias("ids"), F.bool_or("asks").alias("asks"))
    firsts = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    items = written(salted.groupBy("embedding").agg(firsts.alias("ids"), F.bool_or("asks").alias("asks")).select(F.col("ids")[0].alias("item"), "embedding", F.size("embedding").alias("dim"), "ids", "asks"), "items")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = {r["dim"]: (r["m"] * (1 + 1e-12), r["n"]) for r in items.groupBy("dim").agg(F.max(norm).alias("m"), F.count("*").alias("n")).collect()}
    if not longest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    block_rows = {dim: max(64, block_bytes // (4 * dim)) for dim in longest}
    cuts = _cuts(items, longest, block_rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dimension(batches):
            v = _rows(part.column(2), dim)
            h, packed = hashed(v, longest[dim][0]), _packed(v, kind)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.full(part.num_rows, t, dtype=np.int32)), pa.array(cuts.block(dim, t, h[t])), pa.array(h[t]), part.column(0), packed], ["dim", "tree", "block", "hash", "item", "vector"])

    forest = written(items.select("item", "dim", "embedding").mapInArrow(index, "dim int, tree int, block int, hash long, item long, vector binary"), "forest")
    key = ["dim", "tree", "block"]
    # a row a block, of which there are few
    sizes = forest.groupBy(*key).agg(F.count("*").alias("n")).toArrow().to_pylist()
    for dim in longest:
        for t in range(TREES):
            cuts.totals[dim, t] = np.zeros(len(cuts.of(dim, t)) + 1, dtype=np.int64)
    for r in sizes:
        cuts.totals[r["dim"], r["tree"]][r["block"]] = r["n"]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dimension(batches):
            v = _rows(part.column(2), dim)
            h, packed = hashed(v, None), _packed(v, kind)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.full(part.num_rows, t, dtype=np.int32)), pa.array(cuts.block(dim, t, h[t])), pa.array(h[t]), part.column(0), packed, pa.array(list(cuts.beyond(dim, t, h[t])), pa.list_(pa.int64()))], ["dim", "tree", "block", "hash", "item", "vector", "counts"])

    asks = written(items.where("asks").select("item", "dim", "embedding").mapInArrow(descend, "dim int, tree int, block int, hash long, item long, vector binary, counts array<long>"), "asks")
    parts = {(r["dim"], r["tree"], r["block"]): -(-r["n"] // (2 * block_rows[r["dim"]])) for r in sizes}

    def dealt(entries: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Entries by parts, and queries (with ``block``) by slices; each entry goes to the slices of its block's queries, each query to its block's parts."""
        wanted = queries.groupBy(*key).agg(F.count("*").alias("n")).toArrow().to_pylist()
        known = [(r["dim"], r["tree"], r["block"], parts[r["dim"], r["tree"], r["block"]], -(-r["n"] // (2 * block_rows[r["dim"]]))) for r in wanted if (r["dim"], r["tree"], r["block"]) in parts]
        blocks = F.broadcast(spark.createDataFrame(known, "dim int, tree int, block int, parts int, slices int"))
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
        a = entries.join(blocks, key).withColumn("part", own("parts")).withColumn("slice", all_of("slices")).drop("parts", "slices")
        q = queries.join(blocks, key).withColumn("slice", own("slices")).withColumn("part", all_of("parts")).drop("parts", "slices")
        return a, q, [*key, "part", "slice"]

    def count(a: pa.Table, q: pa.Table) -> pa.Table:
        """Entries of the part at each prefix length of each query."""
        h, s = np.sort(a["hash"].to_numpy()), q["hash"].to_numpy()
        counts = np.empty((len(s), BITS + 1), dtype=np.int64)
        for bits in range(BITS + 1):
            low = (s >> (BITS - bits)) << (BITS - bits)
            counts[:, bits] = np.searchsorted(h, low + (1 << (BITS - bits))) - np.searchsorted(h, low)
        return pa.table({"item": q["item"], "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    a, q, group = dealt(forest.select(*key, "hash", "item"), asks.select(*key, "hash", "item"))
    counted = a.groupBy(*group).cogroup(q.groupBy(*group)).applyInArrow(lambda a, q: count(a, q), "item long, counts array<long>").unionByName(asks.select("item", "counts"))
    summed = counted.groupBy("item").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BITS + 1)]).alias("counts"))
    enough = spark.createDataFrame([(d, int(m)) for d, m in _enough(items, longest, k, probes).items()], "dim int, enough long")
    level = F.greatest(F.lit(0), F.size(F.filter("counts", lambda c: c >= F.col("enough"))) - 1)
    levels = written(items.where("asks").select("item", "dim").join(summed, "item").join(F.broadcast(enough), "dim").select("item", level.alias("level")), "levels")

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query at every block that its stretch of strings touches."""
        for dim, b in _by_dimension(batches):
            tree, h, left = b.column(1).to_numpy(), b.column(2).to_numpy(), BITS - b.column(5).to_numpy().astype(np.int64)
            low = (h >> left) << left
            high = low + (np.int64(1) << left) - 1
            from_, to = np.zeros(len(h), dtype=np.int32), np.zeros(len(h), dtype=np.int32)
            for t in np.unique(tree):
                at = tree == t
                from_[at], to[at] = cuts.block(dim, int(t), low[at]), cuts.block(dim, int(t), high[at])
            n = to - from_ + 1
            of = np.repeat(np.arange(len(h)), n)
            block = (from_[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(block), b.column(3).take(take), b.column(4).take(take), pa.array(low[of]), pa.array(high[of])], ["dim", "tree", "block", "item", "vector", "low", "high"])

    reach = asks.join(levels, "item").select("dim", "tree", "hash", "item", "vector", "level")
    reached = written(reach.mapInArrow(ascend, "dim int, tree int, block int, item long, vector binary, low long, high long"), "reached")

    def best_of(a: pa.Table, q: pa.Table) -> pa.Table:
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if a.num_rows and q.num_rows:
            a = a.sort_by("hash")
            item = a["item"].to_numpy()
            for i, e, s in nearest(a["hash"].to_numpy(), item, _unpacked(a["vector"], kind), _unpacked(q["vector"], kind), q["low"].to_numpy(), q["high"].to_numpy(), k + 1):
                found.append((q["item"].to_numpy()[i], item[e], s))
        return pa.table({n: np.concatenate(x) for n, x in zip(("asked", "item", "score"), zip(*found, strict=True), strict=True)})

    a, q, group = dealt(forest, reached)
    hits = a.groupBy(*group).cogroup(q.groupBy(*group)).applyInArrow(lambda a, q: best_of(a, q), "asked long, item long, score double")
    once = hits.groupBy("asked", "item").agg(F.max("score").alias("score"))
    chosen = once.withColumn("at", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "item"))).where(F.col("at") <= k + 1).drop("at")
    order = [F.desc("score"), "vec_id"]
    best = written(chosen.join(items.select("item", "ids"), "item").select("asked", "score", F.explode("ids").alias("vec_id")), "nearest")
    # every row that asks, by its vector
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    named = asking.join(items.where("asks").select("embedding", F.col("item").alias("asked")), "embedding").select("query_id", "asked")
    out = named.join(best, "asked").where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cuts(items: DataFrame, longest: dict, block_rows: dict) -> Cuts:
    """Quantiles of the strings of a sample, as many as blocks are needed."""
    blocks = {dim: min(MOST_BLOCKS, -(-n // block_rows[dim])) for dim, (_, n) in longest.items()}
    cut = [dim for dim, n in blocks.items() if n > 1]
    if not cut:
        return Cuts({})
    total = sum(n for _, n in longest.values())
    sample = items.where(F.col("dim").isin(cut) & (F.pmod(F.xxhash64(F.lit("cut"), "item"), F.lit(total)) < SAMPLE))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dimension(batches):
            for t, h in enumerate(hashed(_rows(part.column(1), dim), longest[dim][0])):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(h), t, dtype=np.int32)), pa.array(h)], ["dim", "tree", "hash"])

    drawn = sample.select("dim", "embedding").mapInArrow(strings, "dim int, tree int, hash long").groupBy("dim", "tree").agg(F.array_sort(F.collect_list("hash")).alias("h"))
    ends = {}
    for r in drawn.collect():
        h, n = np.array(r["h"], dtype=np.int64), blocks[r["dim"]]
        ends[r["dim"], r["tree"]] = np.unique(h[np.arange(1, n) * len(h) // n])
    return Cuts(ends)


def _enough(items: DataFrame, longest: dict, k: int, probes: int) -> dict[int, int]:
    """For each dimension, how many entries (over all trees) a query must reach for the recall.

    At most ``probes`` vectors are held against all, each batch returning its nearest and the number of its entries at each prefix length.
    """
    sample = items.select("item", "dim", "embedding").orderBy(F.xxhash64(F.lit("probe"), "item")).limit(probes).collect()
    probe = {d: (np.array([r["item"] for r in sample if r["dim"] == d]), np.array([r["embedding"] for r in sample if r["dim"] == d], dtype=np.float64)) for d in {r["dim"] for r in sample}}
    strings = {d: hashed(v, None) for d, (_, v) in probe.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in _by_dimension(batches):
            if dim in probe:
                item, v = b.column(0).to_numpy(), _rows(b.column(2), dim)
                h = hashed(v, longest[dim][0])
                for i, q in enumerate(probe[dim][1]):
                    s = v @ q
                    s[item == probe[dim][0][i]] = -np.inf
                    bits = shared_bits(h, strings[dim][:, i : i + 1])
                    counts = np.bincount(bits.ravel(), minlength=BITS + 1)[::-1].cumsum()[::-1]
                    top = np.argsort(-s, kind="stable")[:k]
                    top = top[np.isfinite(s[top])]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([i], pa.int32()), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([s[top].tolist()], pa.list_(pa.float64())), pa.array([bits.max(axis=0)[top].tolist()], pa.list_(pa.int32()))], ["dim", "probe", "counts", "scores", "bits"])

    got = items.select("item", "dim", "embedding").mapInArrow(run, "dim int, probe int, counts array<long>, scores array<double>, bits array<int>")
    pairs = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("scores", "bits"))), False), 1, k)
    rows = got.groupBy("dim", "probe").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BITS + 1)]).alias("counts"), pairs.alias("top")).collect()
    enough = {}
    for dim, (_, n) in longest.items():
        own = [r for r in rows if r["dim"] == dim and r["top"]]
        enough[dim] = n
        for share in SHARES:
            reached = []
            for r in own:
                level = max([b for b, c in enumerate(r["counts"]) if c >= share * n], default=0)
                reached.append(np.mean([t["bits"] >= level for t in r["top"]]))
            if own and np.mean(reached) >= RECALL:
                enough[dim] = math.ceil(share * n)
                break
        else:
            enough[dim] = TREES * n
    return enough


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
