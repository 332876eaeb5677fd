"""Graph statistics as one-row tables and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.operators.model import Graph


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def node_lengths(g: Graph) -> DataFrame:
    """count, total, min, max and mean of node lengths; zeros for an empty graph."""
    n = F.length("seq").cast("long")
    return g.nodes.agg(F.count("*").alias("count"), _zero(F.sum(n)).alias("total"), _zero(F.min(n)).alias("min"), _zero(F.max(n)).alias("max"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"))


def n50(g: Graph) -> DataFrame:
    """The first length, going down, at which twice the running sum reaches the total. Lengths are collapsed first."""
    sizes = g.nodes.groupBy(F.length("seq").cast("long").alias("len")).agg(F.count("*").alias("n"))
    w = W.orderBy(F.desc("len"))
    run = sizes.select("len", F.sum(F.col("len") * F.col("n")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum(F.col("len") * F.col("n")).over(W.partitionBy()).alias("total"))
    return run.where("2 * cum >= total").agg(_zero(F.max("len")).alias("n50"))


def component_sizes(g: Graph) -> DataFrame:
    """``(component, nodes)`` of weakly connected components; orientation does not count."""
    ends = connected_components(g.edges.select("from_node", "to_node"), "from_node", "to_node")
    named = g.nodes.select("node_id").join(ends.withColumnRenamed("node", "node_id"), "node_id", "left")
    return named.groupBy(F.coalesce("component", "node_id").alias("component")).agg(F.count("*").alias("nodes"))


def components_summary(g: Graph) -> DataFrame:
    return component_sizes(g).agg(F.count("*").alias("components"), _zero(F.max("nodes")).alias("largest"))


def degrees(g: Graph) -> DataFrame:
    """``(node_id, indeg, outdeg)`` by the stored direction; a self loop adds one to each."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("from_node").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_node").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    tally = ends.groupBy("node_id").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    return g.nodes.select("node_id").join(tally, "node_id", "left").select("node_id", _zero(F.col("indeg")).alias("indeg"), _zero(F.col("outdeg")).alias("outdeg"))


def degree_stats(g: Graph) -> DataFrame:
    """min, max, mean of in- and out-degree over all nodes, and nodes without an edge."""
    out = []
    for c, n in (("indeg", "in"), ("outdeg", "out")):
        out += [_zero(F.min(c)).alias(f"{n}_min"), _zero(F.max(c)).alias(f"{n}_max"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{n}_mean")]
    return degrees(g).agg(*out, F.count_if(F.expr("indeg + outdeg = 0")).alias("isolated"))


def degree_histogram(g: Graph) -> DataFrame:
    """``(degree, n)`` of total degrees, ascending."""
    return degrees(g).groupBy((F.col("indeg") + F.col("outdeg")).alias("degree")).agg(F.count("*").alias("n")).orderBy("degree")


def path_lengths(g: Graph) -> DataFrame:
    """``(path_idx, name, steps, bp)``: bp is the nodes' lengths less the whole overlap list, 0 at least."""
    spelled = g.steps.join(g.nodes.select("node_id", F.length("seq").cast("long").alias("len")), "node_id").groupBy("path_idx").agg(F.count("*").alias("steps"), F.sum("len").alias("len"))
    lap = F.aggregate(F.coalesce("overlaps", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return g.paths.join(spelled, "path_idx", "left").select("path_idx", "name", _zero(F.col("steps")).alias("steps"), F.greatest(F.lit(0).cast("long"), _zero(F.col("len")) - lap).alias("bp"))


def path_stats(g: Graph) -> DataFrame:
    return path_lengths(g).agg(
        F.count("*").alias("paths"), _zero(F.sum("bp")).alias("bp_total"), _zero(F.min("bp")).alias("bp_min"), _zero(F.max("bp")).alias("bp_max"), F.coalesce(F.avg("bp"), F.lit(0.0)).alias("bp_mean"),
        _zero(F.min("steps")).alias("steps_min"), _zero(F.max("steps")).alias("steps_max"), F.coalesce(F.avg("steps"), F.lit(0.0)).alias("steps_mean"), _zero(F.sum("steps")).alias("steps_total"),
    )


def graph_stats(g: Graph) -> DataFrame:
    """All statistics in one row; the parts have one row each, so joining them moves nothing."""
    parts = [
        g.counts().drop("has_names"),
        node_lengths(g).toDF(*[f"length_{c}" for c in ("count", "total", "min", "max", "mean")]),
        n50(g),
        components_summary(g),
        degree_stats(g),
        degree_histogram(g).agg(F.array_sort(F.collect_list(F.struct("degree", "n"))).alias("degree_histogram")),
        path_stats(g).drop("paths"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
