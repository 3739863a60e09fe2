"""A region dictionary: labels of a tree of places, matched within texts.

``Places`` is a small dictionary, read from configuration, whose labels are a constant of the plan. ``label_table`` and ``matched`` are the same for a dictionary of
any size in a table: stretches of the texts meet labels by hash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bind, normalize_region
from tidemark.sources.store import saved

LEVELS = {"province": 0, "special_region": 0, "city": 1, "prefecture": 1, "county": 2, "district": 2}
#: Labels that a plan may carry; more belong in a table of their own (``label_table``).
MOST = 20_000
#: Labels (and beginnings of labels) that are broadcast; characters of a text that are worked on as one row.
BROADCAST, BLOCK = 200_000, 64
#: Beyond that a sketch of the labels' hashes is broadcast: bits for each label, numbers of 64 bits in a row, and rows at most (32 MB in all).
BITS, NUMBERS, ROWS = 16, 512, 8192
#: Lengths at which a tier of labels begins.
TIERS = (6, 12)
_SCHEMA = "array<struct<level:int,length:int,place:int,label:string,code:string,path:array<string>>>"


class Places:
    """Entries with code, name, aliases, level and parent; every code once."""

    def __init__(self, entries: Iterable[Mapping]):
        self.entries = list(entries)
        self.by_code = {e["code"]: e for e in self.entries}
        if len(self.by_code) < len(self.entries):
            raise ValueError("a region code occurs twice")

    def chain(self, code: str | None) -> list[Mapping]:
        """From the root to the entry; a parent that is missing ends it."""
        found: list[Mapping] = []
        while code in self.by_code and self.by_code[code] not in found:
            found.insert(0, self.by_code[code])
            code = found[0].get("parent")
        return found

    def descendants(self, code: str) -> set[str]:
        return {e["code"] for e in self.entries if e["code"] != code and any(x["code"] == code for x in self.chain(e["code"]))}

    def selected(self, codes: Iterable[str], excluded: Iterable[str] = ()) -> list[Mapping]:
        """The places and all below them, without the excluded ones."""
        wanted = set(codes)
        wanted |= {d for c in wanted for d in self.descendants(c)}
        return [e for e in self.entries if e["code"] in wanted - set(excluded)]

    def labels(self) -> Column:
        """All labels as one constant array, best last."""
        rows = []
        for i, e in enumerate(self.entries):
            for label in {e["name"], *e.get("aliases", ())}:
                plain = re.sub(r"[\s，。、；：:（）()【】\[\]「」《》/\\_\-]+", "", label).lower()  # as normalize_region
                if plain:
                    rows.append({"level": LEVELS.get(e["level"], 0), "length": len(plain), "place": -i, "label": plain, "code": e["code"], "path": [x["name"] for x in self.chain(e["code"])]})
        if len(rows) > MOST:
            raise ValueError(f"{len(rows)} labels are more than a plan should carry: use label_table and matched")
        return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), _SCHEMA)  # folded once to a constant

    def match(self, text: Column) -> Column:
        """Struct of code and path of the deepest place named, of equal ones that with the longest label, then the first; null if none."""
        best = bind(normalize_region(text), lambda whole: F.array_max(F.filter(self.labels(), lambda x: F.contains(whole, x.label))))
        return bind(best, lambda b: F.when(b.isNotNull(), F.struct(b.code.alias("code"), b.path.alias("path"))))


def label_table(entries: DataFrame) -> DataFrame:
    """(label, length, level, place, code, path): every normalised name and alias of a table of places (code, name, aliases, level, parent, place).

    ``place`` is the order of the entries, which decides between labels that are alike; ``path`` are names from the root. A parent that is missing, or that would make
    a circle, ends the path. Labels that normalise to nothing are left out. A code that occurs twice is an error.
    """
    twice = entries.groupBy("code").count().where("count > 1").first()
    if twice:
        raise ValueError(f"region code {twice['code']} occurs twice")
    above = entries.select(F.col("code").alias("up"), F.col("name").alias("up_name"), F.col("parent").alias("up_parent"))
    paths = saved(entries.select("code", F.array("name").alias("path"), F.array("code").alias("seen"), F.when(F.col("parent") != F.col("code"), F.col("parent")).alias("up")), "places")
    # the size that Spark expects of a dictionary is that of compressed files: sides are merged, none is broadcast by it
    while paths.where("up is not null").limit(1).count():  # a round for each level of the tree
        up = F.when(~F.array_contains("seen", F.col("up_parent")), F.col("up_parent"))
        paths = saved(paths.join(above.hint("merge"), "up", "left").select("code", F.when(F.col("up_name").isNull(), F.col("path")).otherwise(F.concat(F.array("up_name"), "path")).alias("path"), F.concat("seen", F.array(F.coalesce("up", "code"))).alias("seen"), up.alias("up")), "places")
    rank = F.create_map(*[x for level, n in LEVELS.items() for x in (F.lit(level), F.lit(n))])
    level = F.coalesce(F.try_element_at(rank, F.col("level")), F.lit(0))
    every = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    labels = entries.select("code", "place", level.alias("level"), every.alias("label")).withColumn("label", normalize_region(F.col("label"))).where("label <> ''").distinct()
    return labels.join(paths.select("code", "path").hint("merge"), "code").select("label", F.length("label").alias("length"), "level", "place", "code", "path")


def _heads(labels: DataFrame, tiers: list[int]) -> tuple[DataFrame, int]:
    """The first characters of labels, as many as the shortest label of their tier has, with the lengths of labels that begin so; and how many there are."""
    tier = F.greatest(*[F.when(F.col("length") >= t, t) for t in tiers], F.lit(tiers[0]))
    heads = labels.groupBy(F.left("label", tier).alias("_head")).agg(F.collect_set("length").alias("_lengths"))
    return heads, heads.count()


def _place(h: Column, rows: int) -> tuple[Column, Column, Column]:
    """Row, number and bit of a hash in a sketch."""
    part = lambda by, n: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(n - 1).cast("long")).cast("int")
    return part(0, rows), part(20, NUMBERS), part(32, 64)


def _perhaps(found: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Rows of ``found`` whose label is one of the ``n`` labels, and few others: those whose bit in a sketch of bounded size is set."""
    rows = 1
    while rows < ROWS and rows * NUMBERS * 64 < BITS * n:
        rows *= 2
    row, number, bit = _place(F.xxhash64("label"), rows)
    bits = labels.select(row.alias("_row"), number.alias("_number"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits"))
    every = labels.sparkSession.range(rows * NUMBERS).select(F.floor(F.col("id") / NUMBERS).cast("int").alias("_row"), (F.col("id") % NUMBERS).cast("int").alias("_number"), F.lit(0).cast("long").alias("_bits"))
    numbers = bits.unionByName(every).groupBy("_row", "_number").agg(F.bit_or("_bits").alias("_bits"))
    sketch = numbers.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_number", "_bits")))["_bits"].alias("_sketch"))
    at = found.withColumns({"_at_row": row, "_at_number": number, "_at_bit": bit})
    held = (F.col("_at_row") == F.col("_row")) & (F.getbit(F.get("_sketch", F.col("_at_number")), F.col("_at_bit")) == 1)
    return at.join(F.broadcast(sketch), held, "left_semi").drop("_at_row", "_at_number", "_at_bit")


def matched(texts: DataFrame, keys: list[str], text: str, labels: DataFrame) -> DataFrame:
    """``keys``, code and path of the deepest place that a text names, of equal ones that with the longest label, then the first; no row for texts that name none.

    Every place of a text where a label can begin (its first characters, by tiers of the labels' lengths as many as the shortest of the tier has, begin some label of the tier) is cut to the
    lengths that such labels have, and these stretches meet the labels by hash; what wins is an aggregation. ``labels`` (a written table, as of ``label_table``) are read several times. They are broadcast up to a count; beyond
    it a sketch of their hashes is, of 32 MB at most, so that hardly any stretches but labels are shuffled. Where the beginnings are too many to be broadcast, those of the longest tier are cut shorter.
    Rows of equal keys are one text. Null texts name nothing.
    """
    size = labels.agg(F.min("length").alias("least"), F.max("length").alias("most"), F.count("*").alias("n")).first()
    if not size["n"]:
        return texts.select(*keys, F.lit(None).cast(labels.schema["code"].dataType).alias("code"), F.lit(None).cast("array<string>").alias("path")).limit(0)
    least, most, block = size["least"], size["most"], max(BLOCK, size["most"])
    cut = texts.select(*keys, F.regexp_extract_all(normalize_region(F.col(text)), F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("_blocks"))
    # a block and the beginning of the next: a label may run over
    rows = cut.select(*keys, F.explode(F.transform("_blocks", lambda b, i: F.struct(F.length(b).alias("own"), F.concat(b, F.left(F.coalesce(F.get("_blocks", i + 1), F.lit("")), F.lit(most - 1))).alias("of")))).alias("_b"))
    begins = rows.select(*keys, F.col("_b.of").alias("_of"), F.explode(F.sequence(F.lit(1), F.col("_b.own"))).alias("_at"))
    tiers = sorted({least, *[t for t in TIERS if least < t <= most]})
    heads, n_heads = _heads(labels, tiers)
    while n_heads > BROADCAST and len(tiers) > 1:
        tiers = sorted({*tiers[:-1], max(tiers[-2], tiers[-1] - 2)})
        heads, n_heads = _heads(labels, tiers)
    begins = begins.withColumn("_head", F.explode(F.array(*[F.substring("_of", F.col("_at"), F.lit(t)) for t in tiers])))
    starts = begins.join(F.broadcast(heads) if n_heads <= BROADCAST else heads.hint("merge"), "_head").select(*keys, F.col("_of"), "_at", F.explode("_lengths").alias("_length"))
    stretches = starts.select(*keys, F.substring("_of", F.col("_at"), F.col("_length")).alias("label"), "_length").where(F.length("label") == F.col("_length")).drop("_length")
    few = size["n"] <= BROADCAST
    named = F.broadcast(labels) if few else labels.hint("merge")
    stretches = stretches if few else _perhaps(stretches, labels, size["n"]).distinct()
    best = F.max(F.struct("level", "length", (-F.col("place")).alias("place"), "code", "path"))
    return stretches.join(named, "label").groupBy(*keys).agg(best.alias("_x")).select(*keys, "_x.code", "_x.path")


def region_passes(wanted: Column, actual: Column, whole: Column, exact: bool = False) -> Column:
    """One level of a region filter: the wanted name occurs in the whole place, or the level is empty, or one name holds the other."""
    w, a, t = normalize_region(wanted), normalize_region(actual), normalize_region(whole)
    return F.when(w == "", True).when(t == "", not exact).otherwise(F.contains(t, w) | (a == "") | F.contains(a, w) | F.contains(w, a))
