"""Graphs derived from the relational test tables, as DataFrames and as the same SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators.links import canonical_link
from strandloom.operators.model import EDGES, PATHS, STEPS, Graph, dense_rank_of, rank_in_lots
from strandloom.plans.runtime import cut, table

HEX, DNA = "0123456789abcdef", "ACGT" * 4
LETTERS, LETTER_DNA = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
#: Bytes of a table that make one partition.
SHARE = 4 << 20
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate", "l_extendedprice"]

VIEWS = f"""
nodes AS (SELECT p_partkey AS node_id, substr(translate(md5(CAST(p_partkey AS VARCHAR)), '{HEX}', '{DNA}'), 1, 8 + p_size % 25) AS seq, 's' || p_partkey AS name FROM part),
steps AS (SELECT l_orderkey AS path_idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS BIGINT) AS pos, l_partkey AS node_id, l_returnflag = 'R' AS is_rev, CAST(l_quantity AS BIGINT) % 4 AS lap, l_quantity FROM lineitem),
paths AS (SELECT path_idx, 'o' || path_idx AS name, coalesce(list(lap ORDER BY pos) FILTER (WHERE pos > 0), []) AS laps FROM steps GROUP BY path_idx),
pairs AS (SELECT path_idx, pos, node_id AS from_node, is_rev AS from_rev, lead(node_id) OVER w AS to_node, lead(is_rev) OVER w AS to_rev, lead(lap) OVER w AS lap, l_quantity AS q1, lead(l_quantity) OVER w AS q2 FROM steps WINDOW w AS (PARTITION BY path_idx ORDER BY pos)),
edges AS (SELECT CAST(row_number() OVER (ORDER BY from_node, from_rev, to_node, to_rev) - 1 AS BIGINT) AS edge_idx, from_node, from_rev, to_node, to_rev, min(lap) AS overlap FROM pairs WHERE to_node IS NOT NULL GROUP BY from_node, from_rev, to_node, to_rev)
"""


def spread(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions for the rows of a table: they grow with it, so that a task's share does not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // SHARE))


def order_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path_idx, w)``: the line items of each order as one array of (node_id, is_rev, lap, l_quantity), in order.

    It is written once, and all else of paths is read off it in place.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).repartition(spread(spark, sf_dir, "lineitem"), "l_orderkey")
    walks = items.groupBy(F.col("l_orderkey").alias("path_idx")).agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER))).alias("w"))
    step = lambda x: F.struct(x["l_partkey"].alias("node_id"), (x["l_returnflag"] == "R").alias("is_rev"), (x["l_quantity"].cast("long") % 4).alias("lap"), x["l_quantity"].alias("l_quantity"))
    return cut(walks.select("path_idx", F.transform("w", step).alias("w")), "walks")


def order_steps(walks: DataFrame) -> DataFrame:
    return walks.select("path_idx", F.posexplode("w").alias("p", "x")).select("path_idx", F.col("p").cast("long").alias("pos"), "x.*")


def order_pairs(walks: DataFrame) -> DataFrame:
    """:func:`step_pairs` of the orders, from neighbours in their arrays."""
    both = F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))
    met = walks.select("path_idx", F.posexplode(both).alias("p", "x")).where("x.b is not null")
    a, b = F.col("x.a"), F.col("x.b")
    ends = [x[c].alias(f"{n}_{c.removeprefix('is_').removesuffix('_id')}") for n, x in (("from", a), ("to", b)) for c in ("node_id", "is_rev")]
    return met.select("path_idx", F.col("p").cast("long").alias("pos"), *ends, b["lap"].alias("lap"), a["l_quantity"].alias("q1"), b["l_quantity"].alias("q2"))


def step_pairs(steps: DataFrame) -> DataFrame:
    w = W.partitionBy("path_idx").orderBy("pos")
    return steps.select("path_idx", "pos", F.col("node_id").alias("from_node"), F.col("is_rev").alias("from_rev"), F.lead("node_id").over(w).alias("to_node"), F.lead("is_rev").over(w).alias("to_rev"), F.lead("lap").over(w).alias("lap"), F.col("l_quantity").alias("q1"), F.lead("l_quantity").over(w).alias("q2")).where("to_node is not null")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.substring(F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), HEX, DNA), F.lit(1), F.lit(8) + F.col("p_size") % 25)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), seq.alias("seq"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"))


def _graph(spark: SparkSession, sf_dir: str, walks: DataFrame) -> Graph:
    laps = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x["lap"])
    paths = walks.select("path_idx", F.concat(F.lit("o"), F.col("path_idx").cast("string")).alias("name"), laps.alias("overlaps"))
    ends = ["from_node", "from_rev", "to_node", "to_rev"]
    # a lot's links meet once, for the distinct and for their ranks
    pairs = order_pairs(walks).select(F.shiftright("from_node", 12).alias("lot"), *ends, "lap").repartition(spread(spark, sf_dir, "lineitem"), "lot")
    links = pairs.groupBy("lot", *ends).agg(F.min("lap").alias("overlap"))
    edges = rank_in_lots(links, "lot", ends, "edge_idx", "overlap").select("edge_idx", *ends, "overlap")
    return Graph(part_nodes(spark, sf_dir), edges, paths, order_steps(walks).select("path_idx", "pos", "node_id", "is_rev"))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts are nodes, orders are paths, line items are steps; links are the neighbours on paths."""
    return _graph(spark, sf_dir, order_walks(spark, sf_dir))


def sparse_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Links only between neighbours that both have 45 pieces or more: many small components."""
    walks = order_walks(spark, sf_dir)
    pairs = order_pairs(walks).where("q1 >= 45 and q2 >= 45")
    edges = pairs.select(F.lit(0).cast("long").alias("edge_idx"), "from_node", "from_rev", "to_node", "to_rev", F.lit(0).cast("long").alias("overlap")).distinct()
    return _graph(spark, sf_dir, walks).with_(edges=edges)


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The nodes of :func:`order_graph` alone."""
    none = lambda schema: spark.createDataFrame([], schema)
    return Graph(part_nodes(spark, sf_dir), none(EDGES), none(PATHS), none(STEPS))


def text_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """One node and one path per document, its letters read as bases; all else is a gap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), LETTERS, LETTER_DNA).alias("seq"))
    nodes = docs.select(F.col("doc_id").alias("node_id"), "seq", F.lit(None).cast("string").alias("name"))
    paths = docs.select(F.col("doc_id").alias("path_idx"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.array().cast("array<bigint>").alias("overlaps"))
    steps = docs.select(F.col("doc_id").alias("path_idx"), F.lit(0).cast("long").alias("pos"), F.col("doc_id").alias("node_id"), F.lit(False).alias("is_rev"))
    none = spark.createDataFrame([], "edge_idx long, from_node long, from_rev boolean, to_node long, to_rev boolean, overlap long")
    return Graph(nodes, none, paths, steps, has_names=False)


TEXT_VIEW = f"dna AS (SELECT doc_id AS path_idx, 'd' || doc_id AS name, upper(translate(lower(text), '{LETTERS}', '{LETTER_DNA}')) AS seq FROM documents)"

EVENT_VIEW = """
kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS node_id FROM (SELECT DISTINCT event_type FROM events)),
visits AS (SELECT user_id AS path_idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, node_id FROM events JOIN kinds USING (event_type))
"""


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types are nodes, users are paths through them: small and dense, with self loops."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().select("event_type", (F.row_number().over(W.orderBy("event_type")) - 1).cast("long").alias("node_id"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("path_idx"), (F.row_number().over(w) - 1).cast("long").alias("pos"), "node_id", F.lit(False).alias("is_rev"), F.lit(0).cast("long").alias("lap"), F.lit(0).alias("l_quantity"))
    links = step_pairs(steps).select("from_node", "from_rev", "to_node", "to_rev").distinct()
    keyed = links.withColumn("key", F.struct("from_node", "from_rev", "to_node", "to_rev"))
    edges = dense_rank_of(keyed, "key", "edge_idx", F.shiftright("from_node", 12)).select("edge_idx", *links.columns, F.lit(0).cast("long").alias("overlap"))
    paths = steps.select("path_idx").distinct().select("path_idx", F.concat(F.lit("u"), F.col("path_idx").cast("string")).alias("name"), F.array().cast("array<bigint>").alias("overlaps"))
    return Graph(kinds.select("node_id", F.repeat(F.lit("ACGT"), 2).alias("seq"), F.col("event_type").alias("name")), edges, paths, steps.select("path_idx", "pos", "node_id", "is_rev"))


__all__ = ["EVENT_VIEW", "TEXT_VIEW", "VIEWS", "canonical_link", "event_graph", "order_graph", "order_pairs", "order_steps", "order_walks", "part_graph", "part_nodes", "sparse_graph", "step_pairs", "text_graph"]
