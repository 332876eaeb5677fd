"""Edits: each gives a new graph. Ids stay dense, in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators.model import EDGES, NODES, PATHS, STEPS, Graph, InvalidGraph, dense_rank_of


def _next(df: DataFrame, column: str) -> int:
    top = df.agg(F.max(column)).first()[0]
    return 0 if top is None else top + 1


def add_node(g: Graph, seq: str, name: str | None = None) -> tuple[Graph, int]:
    i = _next(g.nodes, "node_id")
    return g.with_(nodes=g.nodes.unionByName(g.spark.createDataFrame([(i, seq, name)], NODES)), has_names=g.has_names or name is not None), i


def _require_nodes(g: Graph, ids: set[int]) -> None:
    known = {r[0] for r in g.nodes.where(F.col("node_id").isin(sorted(ids))).select("node_id").collect()} if ids else set()
    if missing := ids - known:
        raise InvalidGraph(f"no node {min(missing)}")


def add_edge(g: Graph, from_node: int, from_rev: bool, to_node: int, to_rev: bool, overlap: int = 0) -> tuple[Graph, int]:
    _require_nodes(g, {from_node, to_node})
    i = _next(g.edges, "edge_idx")
    return g.with_(edges=g.edges.unionByName(g.spark.createDataFrame([(i, from_node, from_rev, to_node, to_rev, overlap)], EDGES))), i


def _path(g: Graph, name: str):
    return g.paths.where(F.col("name") == name).first()


def add_path(g: Graph, name: str, steps: list[tuple[int, bool]], overlaps: list[int] = ()) -> tuple[Graph, int]:
    if _path(g, name) is not None:
        raise InvalidGraph(f"path name '{name}' is not unique")
    _require_nodes(g, {n for n, _ in steps})
    i = _next(g.paths, "path_idx")
    rows = g.spark.createDataFrame([(i, p, n, r) for p, (n, r) in enumerate(steps)], STEPS)
    return g.with_(paths=g.paths.unionByName(g.spark.createDataFrame([(i, name, list(overlaps))], PATHS)), steps=g.steps.unionByName(rows)), i


def _renumber(df: DataFrame, column: str) -> DataFrame:
    """Dense again after rows went, without a sort in one task."""
    return dense_rank_of(df.withColumnRenamed(column, "_old"), "_old", column).drop("_old")


def remove_node(g: Graph, node_id: int) -> Graph:
    """Takes the node, its edges and its steps away; ids above it move down by one.

    Paths without steps go too, also those that had none before. Of a path's overlaps those stay whose steps
    were neighbours, and a new junction has 0; a path that steps on no node from this one up keeps its list.
    """
    _require_nodes(g, {node_id})
    down = lambda c: F.when(F.col(c) > node_id, F.col(c) - 1).otherwise(F.col(c)).alias(c)
    nodes = g.nodes.where(F.col("node_id") != node_id).select(down("node_id"), "seq", "name")
    left = g.edges.where((F.col("from_node") != node_id) & (F.col("to_node") != node_id))
    edges = _renumber(left, "edge_idx").select("edge_idx", down("from_node"), "from_rev", down("to_node"), "to_rev", "overlap")
    w = W.partitionBy("path_idx").orderBy("pos")
    met = g.steps.where(F.col("node_id") != node_id).join(g.paths.select("path_idx", "overlaps"), "path_idx")
    stay = met.select("path_idx", (F.row_number().over(w) - 1).cast("long").alias("p"), down("node_id"), "is_rev", F.when(F.lead("pos").over(w).isNull(), None).when(F.lead("pos").over(w) == F.col("pos") + 1, F.coalesce(F.get("overlaps", F.col("pos").cast("int")), F.lit(0))).otherwise(F.lit(0)).alias("lap"))
    laps = stay.where("lap is not null").groupBy("path_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "lap"))), lambda x: x["lap"]).alias("laps"))
    touched = g.steps.groupBy("path_idx").agg(F.max(F.col("node_id") >= node_id).alias("hit"))
    kept = g.paths.join(touched, "path_idx").join(stay.select("path_idx").distinct(), "path_idx", "left_semi").join(laps, "path_idx", "left")
    empty = F.array().cast("array<bigint>")
    paths = kept.select("path_idx", "name", F.when(F.col("hit") & (F.size("overlaps") > 0), F.coalesce("laps", empty)).otherwise(F.col("overlaps")).alias("overlaps"))
    order = dense_rank_of(paths.select("path_idx"), "path_idx", "new")
    renamed = lambda df: df.join(order, "path_idx").drop("path_idx").withColumnRenamed("new", "path_idx")
    return Graph(nodes, edges, renamed(paths).select("path_idx", "name", "overlaps"), renamed(stay).select("path_idx", F.col("p").alias("pos"), "node_id", "is_rev"), g.has_names)


def remove_edge(g: Graph, edge_idx: int) -> Graph:
    if g.edges.where(F.col("edge_idx") == edge_idx).isEmpty():
        raise InvalidGraph(f"no edge {edge_idx}")
    rest = g.edges.where(F.col("edge_idx") != edge_idx)
    return g.with_(edges=rest.withColumn("edge_idx", F.when(F.col("edge_idx") > edge_idx, F.col("edge_idx") - 1).otherwise(F.col("edge_idx"))))


def remove_path(g: Graph, name: str) -> Graph:
    old = get_path(g, name)
    i = old["path_idx"]
    down = F.when(F.col("path_idx") > i, F.col("path_idx") - 1).otherwise(F.col("path_idx"))
    return g.with_(paths=g.paths.where(F.col("path_idx") != i).withColumn("path_idx", down), steps=g.steps.where(F.col("path_idx") != i).withColumn("path_idx", down))


def replace_path(g: Graph, name: str, steps: list[tuple[int, bool]], overlaps: list[int] = ()) -> Graph:
    """The path's steps and overlaps anew; it keeps its place."""
    i = get_path(g, name)["path_idx"]
    _require_nodes(g, {n for n, _ in steps})
    rows = g.spark.createDataFrame([(i, p, n, r) for p, (n, r) in enumerate(steps)], STEPS)
    laps = F.array(*map(F.lit, overlaps)).cast("array<bigint>")
    return g.with_(paths=g.paths.withColumn("overlaps", F.when(F.col("path_idx") == i, laps).otherwise(F.col("overlaps"))), steps=g.steps.where(F.col("path_idx") != i).unionByName(rows))


def set_sequence(g: Graph, node_id: int, seq: str) -> Graph:
    _require_nodes(g, {node_id})
    return g.with_(nodes=g.nodes.withColumn("seq", F.when(F.col("node_id") == node_id, F.lit(seq)).otherwise(F.col("seq"))))


def get_node(g: Graph, node_id: int):
    row = g.nodes.where(F.col("node_id") == node_id).first()
    if row is None:
        raise InvalidGraph(f"no node {node_id}")
    return row


def get_edge(g: Graph, edge_idx: int):
    row = g.edges.where(F.col("edge_idx") == edge_idx).first()
    if row is None:
        raise InvalidGraph(f"no edge {edge_idx}")
    return row


def get_path(g: Graph, name: str):
    row = _path(g, name)
    if row is None:
        raise InvalidGraph(f"no path '{name}'")
    return row
