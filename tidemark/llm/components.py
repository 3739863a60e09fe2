"""Connected components of an edge table, by alternating large and small stars.

Each half round replaces edges by edges to the smallest neighbour; both halves are one aggregation and one
join of the edge table, written to the shared folder. Stars remain when nothing changes. The minima are
written before they are joined, so that both sides of that join are plain exchanges and the adaptive planner
can split a hub that holds a large share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v): each u names its neighbours v. Every neighbour (the larger only, or all and u too) is tied to the least of u and them."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    joined = pairs.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node reachable) for every node that an edge between different nodes touches.

    Edges with a null end and loops join nothing. Repeated edges count once. No edges: no rows.
    """
    held = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    held = written(held.distinct(), "edges")
    before = _state(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, True).distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        held = written(_star(down, False).distinct(), "small")
        now = _state(held)
        if now == before:
            break
        before = now
    roots = held.select(F.col("v").alias("node")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
