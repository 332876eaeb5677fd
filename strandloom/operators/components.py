"""Connected components by alternating large-star and small-star steps (MapReduce-style hooking)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.runtime import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node that ``edges`` names; component is the least node reached.

    Each round is two star steps; the number of rounds grows with the logarithm of the node count, also
    on long chains. Nothing is collected but one row of counters a round, and each round is cut to the
    shared folder. Null endpoints are ignored; self loops yield a node that is its own component;
    repeated edges count once; an empty table gives an empty result.
    """
    known = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes_alone = known.where("a = b").select(F.col("a").alias("node")).distinct()
    now = cut(known.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.max(F.hash("u", "v"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        old, now = now, cut(_small_star(_large_star(now).distinct()).distinct(), "cc")
        discard(old)
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    found = stars.union(roots)
    alone = nodes_alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)
