"""Colored de Bruijn graphs: the input paths as walks over k-mers or unitigs.

Paths are split at gaps into segments that hold at least one k-mer. Segments come in the byte order of path
names and are called ``name``, or ``name.1``, ``name.2``, ... where a path has several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.packed import placed_kmers
from strandloom.functions.seq import check_k
from strandloom.operators.dbg import DeBruijn, from_paths, spelled_chunks
from strandloom.operators.model import Graph, dense_rank_of
from strandloom.operators.unitigs import Unitigs, compact
from strandloom.plans.runtime import cut, ready


@dataclass(frozen=True)
class Colored:
    """A de Bruijn graph, segments(seg_idx, path_idx, name, first_id, first_rev, last_id, last_rev, n_kmers) and walks(seg_idx, pos, node_id, is_rev)."""

    dbg: DeBruijn
    segments: DataFrame
    walks: DataFrame

    def graph(self) -> Graph:
        return _with_paths(self.dbg.graph(), self.dbg.k, self.segments, self.walks)


def _with_paths(g: Graph, k: int, segments: DataFrame, walks: DataFrame) -> Graph:
    n = walks.groupBy("seg_idx").agg(F.count("*").alias("n"))
    laps = F.when(F.col("n") > 1, F.array_repeat(F.lit(k - 1).cast("long"), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    paths = segments.join(n, "seg_idx").select(F.col("seg_idx").alias("path_idx"), "name", laps.alias("overlaps"))
    return g.with_(paths=paths, steps=walks.select(F.col("seg_idx").alias("path_idx"), "pos", "node_id", "is_rev"))


def path_kmers(g: Graph, k: int) -> DataFrame:
    """``(path_idx, chunk, at, h, l, is_rev, starts)``: every gap-free k-mer of every path with its base offset; whether a segment begins there."""
    ready(g.spark)
    # a gap before a path's first base, so that each k-mer has a character before it
    text = spelled_chunks(g, k).withColumn("first", F.length("ctx") < k)
    text = text.select("path_idx", "chunk", (F.col("start") - F.length("ctx") - F.col("first").cast("int")).alias("at"), F.concat(F.when(F.col("first"), "-").otherwise(""), "ctx", "text").alias("text"))
    return placed_kmers(text, k)


def color(g: Graph, k: int) -> Colored:
    check_k(k)
    dbg = from_paths(g, k)
    found = cut(path_kmers(g, k), "pathkmers")
    # the last start before each chunk, from one row a chunk; inside a chunk a running maximum
    last = found.where("starts").groupBy("path_idx", "chunk").agg(F.max("at").alias("last"))
    every = found.select("path_idx", "chunk").distinct().join(last, ["path_idx", "chunk"], "left")
    carried = every.select("path_idx", "chunk", F.max("last").over(W.partitionBy("path_idx").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = F.max(F.when(F.col("starts"), F.col("at"))).over(W.partitionBy("path_idx", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    owned = found.withColumn("inside", inside).join(carried, ["path_idx", "chunk"]).withColumn("at0", F.coalesce("inside", "carried"))
    met = cut(owned.join(dbg.packed.select("h", "l", "node_id"), ["h", "l"]).select("path_idx", "at0", "at", "node_id", "is_rev"), "colored")
    side = F.struct("at", "node_id", "is_rev")
    segs = met.groupBy("path_idx", "at0").agg(F.min(side).alias("f"), F.max(side).alias("l"), F.count("*").alias("n_kmers"))
    own = W.partitionBy("path_idx")
    named = segs.join(g.paths.select("path_idx", F.col("name").alias("path")), "path_idx").withColumn("parts", F.count("*").over(own)).withColumn("seg", F.row_number().over(own.orderBy("at0")))
    named = named.withColumn("name", F.when(F.col("parts") == 1, F.col("path")).otherwise(F.concat("path", F.lit("."), F.col("seg").cast("string")))).withColumn("key", F.struct("path", "seg"))
    numbered = dense_rank_of(named, "key", "seg_idx")
    segments = cut(numbered.select("seg_idx", "path_idx", "name", F.col("f.node_id").alias("first_id"), F.col("f.is_rev").alias("first_rev"), F.col("l.node_id").alias("last_id"), F.col("l.is_rev").alias("last_rev"), "n_kmers", "at0"), "segments")
    walks = met.join(segments.select("path_idx", "at0", "seg_idx"), ["path_idx", "at0"]).select("seg_idx", (F.col("at") - F.col("at0")).alias("pos"), "node_id", "is_rev")
    return Colored(dbg, segments.drop("at0"), walks)


def compact_colored(c: Colored) -> tuple[Unitigs, Graph]:
    """Unitigs that no segment begins or ends inside of, and the graph of them with the segments as paths."""
    ends = c.segments.select(F.explode(F.array(F.col("last_id") * 2 + F.col("last_rev").cast("long"), (F.col("first_id") * 2 + F.col("first_rev").cast("long")).bitwiseXOR(F.lit(1).cast("long")))).alias("side")).distinct()
    u = compact(c.dbg, ends)
    placed = c.walks.join(u.placement.select("node_id", "unitig_id", "offset", F.col("is_rev").alias("turned")), "node_id")
    # a step opens a unitig where its k-mer is the unitig's first in the direction of travel
    size = u.placement.groupBy("unitig_id").agg(F.max("offset").alias("last"))
    run = placed.withColumn("back", F.col("is_rev") != F.col("turned")).join(size, "unitig_id")
    opens = run.where(F.when(F.col("back"), F.col("offset") == F.col("last")).otherwise(F.col("offset") == 0))
    steps = opens.select("seg_idx", (F.row_number().over(W.partitionBy("seg_idx").orderBy("pos")) - 1).cast("long").alias("pos"), F.col("unitig_id").alias("node_id"), F.col("back").alias("is_rev"))
    return u, _with_paths(u.graph(), c.dbg.k, c.segments, steps)
