"""De Bruijn graphs: path spelling, canonical k-mers, dense ids, edge ends, and the full topology."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import blobs
from strandloom.functions.packed import ends_of, joined, keys, merged, neighbours, other_strand, parts_of, signed, spelled, unsigned, words_after
from strandloom.functions.seq import check_k, oriented, rc, runs
from strandloom.operators.model import Graph
from strandloom.plans.runtime import cut, discard, ready

#: Bases of a path that are spelled in one row, about.
CHUNK = 1 << 14
#: Steps whose lengths are summed up in one row of the prefix table.
BLOCK = 1 << 12
#: Windows of texts that one part of the k-mers stands for, about.
PART = 3 << 20
#: Windows that are put in order at once while texts are cut.
FLUSH = 1 << 22
#: Sampled k-mers for each part, about.
SAMPLES = 200


def word_part(bounds: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """The parts that (k+1)-mers belong to."""
    (head, _), _ = ends_of(word, k)
    return np.searchsorted(bounds, head, "right")


class DeBruijn:
    """nodes(node_id, kmer) and edges(edge_idx, kmer1, from_id, from_rev, to_id, to_rev, overlap), ids by sorted rank.

    k-mers lie in parts by range, in order, each with a mask of the bases that follow it on both strands
    (``held``); ids are places in that order. (k+1)-mers are named by these masks and go to the part where
    their first k bases would be, each from both of its ends, so that ids meet without being looked up.
    """

    def __init__(self, k: int, held: DataFrame, bounds: np.ndarray):
        self.k, self.held, self.bounds = k, held, bounds
        self.parts = len(bounds) + 1
        self.starts = blobs.starts_of(held, self.parts)

    @cached_property
    def packed(self) -> DataFrame:
        """``(node_id, h, l, palindrome)``: k-mers as signed longs."""
        k, starts = self.k, self.starts

        def rows(part, columns):
            for s in blobs.slices(len(columns[0])):
                pair = parts_of(columns[0][s], k)
                other = other_strand(*pair, k)
                yield [pa.array(np.arange(s.start, s.stop) + starts[part]), pa.array(signed(pair[0])), pa.array(signed(pair[1])), pa.array((pair[0] == other[0]) & (pair[1] == other[1]))]

        return blobs.each_row(self.held, "node_id long, h long, l long, palindrome boolean", rows)

    @cached_property
    def nodes(self) -> DataFrame:
        k, starts = self.k, self.starts

        def rows(part, columns):
            for s in blobs.slices(len(columns[0])):
                yield [pa.array(np.arange(s.start, s.stop) + starts[part]), spelled(columns[0][s], k)]

        return blobs.each_row(self.held, "node_id long, kmer string", rows)

    def _words(self, ids: bool) -> DataFrame:
        """(k+1)-mers by part, in order; with the node ids of both ends, or alone."""
        k, starts, bounds = self.k, self.starts, self.bounds

        def out(batches):
            for b in batches:
                for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                    found = list(words_after(*blobs.unpack(data), k))
                    for end in range(1 + ids):
                        word, at = (np.concatenate([x[c][x[3 + end]] for x in found]) for c in (2, 1))
                        order = np.argsort(word, kind="stable")
                        word, at = word[order], at[order] + starts[part]
                        yield from blobs.deal(end, word_part(bounds, word, k), word, *([at] if ids else []))

        def own(part, kinds):
            word, *at = kinds[0]
            order = np.argsort(word, kind="stable")
            columns = [word[order], *(a[order] for a in at)]
            if ids:
                columns.append(kinds[1][1][np.argsort(kinds[1][0], kind="stable")])
            yield part, 0, len(word), blobs.pack(*columns)

        return blobs.each_part(blobs.each_batch(self.held, out), self.parts, own)

    @cached_property
    def words(self) -> DataFrame:
        """``(edge_idx, kmer1)`` alone."""
        k, held = self.k, cut(self._words(False), "dbgwords")
        starts = blobs.starts_of(held, self.parts)

        def rows(part, columns):
            for s in blobs.slices(len(columns[0])):
                yield [pa.array(np.arange(s.start, s.stop) + starts[part]), spelled(columns[0][s], k + 1)]

        return blobs.each_row(held, "edge_idx long, kmer1 string", rows)

    @cached_property
    def edges(self) -> DataFrame:
        k, held = self.k, cut(self._words(True), "dbgedges")
        starts = blobs.starts_of(held, self.parts)

        def rows(part, columns):
            for s in blobs.slices(len(columns[0])):
                word, a, b = (c[s] for c in columns)
                (head, head2), (tail, tail2) = ends_of(word, k)
                yield [pa.array(np.arange(s.start, s.stop) + starts[part]), spelled(word, k + 1), pa.array(a), pa.array(head2 < head), pa.array(b), pa.array(tail2 < tail), pa.array(np.full(len(word), k - 1))]

        return blobs.each_row(held, "edge_idx long, kmer1 string, from_id long, from_rev boolean, to_id long, to_rev boolean, overlap long", rows)

    def counts(self) -> DataFrame:
        k = self.k

        def rows(part, columns):
            yield [pa.array([len(columns[0])]), pa.array([sum(int(first.sum()) for *_, first, _ in words_after(*columns, k))])]

        made = blobs.each_row(self.held, "nodes long, edges long", rows)
        return made.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))

    def path_count(self) -> int:
        """A graph without colours has no paths."""
        return 0

    def path_names(self) -> DataFrame:
        return self.graph().paths.select("path_idx", "name")

    def graph(self) -> Graph:
        """Nodes without names, edges with overlap k - 1, no paths."""
        spark = self.packed.sparkSession
        none = spark.createDataFrame([], "path_idx long, name string, overlaps array<long>")
        return Graph(
            self.nodes.select("node_id", F.col("kmer").alias("seq"), F.lit(None).cast("string").alias("name")),
            self.edges.select("edge_idx", F.col("from_id").alias("from_node"), "from_rev", F.col("to_id").alias("to_node"), "to_rev", "overlap"),
            none,
            spark.createDataFrame([], "path_idx long, pos long, node_id long, is_rev boolean"),
            has_names=False,
        )


def spelled_steps(g: Graph) -> DataFrame:
    """``(path_idx, pos, piece)``: each step's oriented bases less the overlap with the step before, clipped to the node."""
    laps = g.paths.select("path_idx", "overlaps")
    met = g.steps.join(g.nodes.select("node_id", "seq"), "node_id").join(laps, "path_idx")
    skip = F.when(F.col("pos") > 0, F.coalesce(F.get("overlaps", (F.col("pos") - 1).cast("int")), F.lit(0))).otherwise(F.lit(0))
    return met.select("path_idx", "pos", oriented("seq", "is_rev", skip).alias("piece"))


def _all_short(g: Graph, size: int) -> bool:
    """Whether no path can have more than ``size`` bases."""
    steps, bases = g.steps.agg(F.max("pos")).first()[0], g.nodes.agg(F.max(F.length("seq"))).first()[0]
    return steps is None or (steps + 1) * (bases or 0) <= size


def spelled_chunks(g: Graph, context: int) -> DataFrame:
    """``(path_idx, chunk, ctx, text)``: paths in pieces of about ``CHUNK`` bases, each with up to ``context`` bases before it.

    Base offsets are prefix sums in two levels (blocks of steps, then inside a block), so a path of any
    length is spelled by many tasks; paths that are all short are spelled whole. Of two neighbouring chunks
    at least one is long, hence the last two hold all context needed.
    """
    size = max(CHUNK, 4 * context)
    g = g.with_(steps=cut(g.steps, "steps"))
    if _all_short(g, size):
        return spelled_paths(g).where("seq <> ''").select("path_idx", F.lit(0).cast("long").alias("chunk"), F.lit("").alias("ctx"), F.col("seq").alias("text"), F.lit(0).cast("long").alias("start"))
    pieces = spelled_steps(g).withColumn("b", F.expr(f"pos div {BLOCK}"))
    blocks = pieces.groupBy("path_idx", "b").agg(F.sum(F.length("piece")).alias("n"))
    before = blocks.select("path_idx", "b", F.coalesce(F.sum("n").over(W.partitionBy("path_idx").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    inside = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("path_idx", "b").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("inside", inside).join(before, ["path_idx", "b"]).withColumn("chunk", F.expr(f"(at + inside) div {size}"))
    text = placed.groupBy("path_idx", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("s"), F.min(F.col("at") + F.col("inside")).alias("start"))
    joined = text.select("path_idx", "chunk", "start", F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("text"))
    if not context:
        return joined.withColumn("ctx", F.lit(""))
    tail = F.when(F.length("text") > context, F.expr(f"right(text, {context})")).otherwise(F.col("text"))
    w = W.partitionBy("path_idx").orderBy("chunk")
    prior = F.concat(F.coalesce(F.lag("tail", 2).over(w), F.lit("")), F.coalesce(F.lag("tail", 1).over(w), F.lit("")))
    # tails travel without the texts
    contexts = joined.select("path_idx", "chunk", tail.alias("tail")).withColumn("p", prior).select("path_idx", "chunk", F.expr(f"right(p, {context})").alias("ctx"))
    return joined.join(contexts, ["path_idx", "chunk"])


def spelled_paths(g: Graph) -> DataFrame:
    """``(path_idx, name, seq)`` of whole paths; a path without steps is empty."""
    parts = spelled_steps(g).groupBy("path_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("s"))
    return g.paths.join(parts, "path_idx", "left").select("path_idx", "name", F.coalesce(F.array_join(F.transform("s", lambda x: x["piece"]), ""), F.lit("")).alias("seq"))


def path_node_sequences(g: Graph) -> DataFrame:
    """``(path_idx, pos, seq)``: the oriented sequence of every step, with the IUPAC complement."""
    from strandloom.functions.seq import rc_iupac

    return g.steps.join(g.nodes.select("node_id", "seq"), "node_id").select("path_idx", "pos", F.when(F.col("is_rev"), rc_iupac("seq")).otherwise(F.col("seq")).alias("seq"))


def _bounds(texts: DataFrame, k: int) -> np.ndarray:
    """Keys that part the k-mers of ``texts`` (run binary) into ranges of about ``PART`` windows, by a sample of them."""
    total = texts.agg(F.coalesce(F.sum(F.length("run")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-total // PART)
    if parts < 2:
        return neighbours(b"", k)[0]
    wanted = parts * SAMPLES
    part = min(1.0, 64 * wanted / total)
    step = max(1, int(total * part / wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in joined(b.column(0).to_pylist()):
                pair = parts_of(neighbours(text, k)[0][step // 2 :: step], k)
                yield pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in pair], names=["h", "l"])

    found = (texts.sample(part, 1) if part < 1 else texts).mapInArrow(run, "h long, l long").toArrow()
    key = np.unique(keys(*(unsigned(found.column(c).to_numpy()) for c in ("h", "l")), k))
    return np.unique(key[np.linspace(0, len(key), parts + 1).astype(np.int64)[1:-1]]) if len(key) else key


def from_texts(texts: DataFrame, text: str, k: int) -> DeBruijn:
    """The graph of all gap-free k-mers of a column of texts."""
    ready(texts.sparkSession)
    texts = cut(texts.select(F.col(text).cast("binary").alias("run")), "runs")
    bounds = _bounds(texts, k)

    def flush(found):
        key, mask = merged(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        return blobs.deal(0, np.searchsorted(bounds, key, "right"), key, mask)

    def out(batches):
        found, size = [], 0
        for b in batches:
            for data in joined(b.column(0).to_pylist()):
                found.append(neighbours(data, k))
                size += len(found[-1][0])
                if size >= FLUSH:
                    yield from flush(found)
                    found, size = [], 0
        if found:
            yield from flush(found)

    def own(part, kinds):
        key, mask = merged(*kinds[0], k)
        yield part, 0, len(key), blobs.pack(key, mask)

    held = cut(blobs.each_part(blobs.each_batch(texts, out), len(bounds) + 1, own), "kmers")
    discard(texts)
    return DeBruijn(k, held, bounds)


def from_paths(g: Graph, k: int) -> DeBruijn:
    """The graph of all k-mers that the paths spell."""
    check_k(k)
    return from_texts(spelled_chunks(g, k).select(F.concat("ctx", "text").alias("run")), "run", k)


def arcs(edges: DataFrame) -> DataFrame:
    """Distinct bidirected arcs ``(from_node, from_rev, to_node, to_rev, overlap)``: every edge and its twin."""
    twin = edges.select(F.col("to_node").alias("from_node"), (~F.col("to_rev")).alias("from_rev"), F.col("from_node").alias("to_node"), (~F.col("from_rev")).alias("to_rev"), "overlap")
    return edges.select("from_node", "from_rev", "to_node", "to_rev", "overlap").union(twin).distinct()


def topology_runs(g: Graph, k: int) -> DataFrame:
    """Gap-free runs that together hold every window of up to k + 1 bases of every walk of the bidirected graph.

    A state is (side, bases walked past the start, last k valid bases). Each round joins the new states with
    the arcs and node sequences and drops states seen before; at most k bases are walked past a start, so
    that each window is found from the node it begins in.
    """
    turned = F.explode(F.array(F.struct(F.lit(False).alias("rev"), F.upper("seq").alias("s")), F.struct(F.lit(True).alias("rev"), F.upper(rc("seq")).alias("s"))))
    sides = cut(g.nodes.select("node_id", turned.alias("x")).select("node_id", "x.rev", "x.s"), "sides")
    found = [sides.where("not rev").select(F.explode(runs("s")).alias("run"))]
    steps = cut(arcs(g.edges), "arcs").join(sides.toDF("to_node", "to_rev", "s"), ["to_node", "to_rev"]).select("from_node", "from_rev", "to_node", "to_rev", F.substring("s", F.least(F.col("overlap"), F.length("s")).cast("int") + 1, F.lit(k)).alias("head"), (F.greatest(F.length("s") - F.col("overlap"), F.lit(0)) > k).alias("more"))
    steps = cut(steps, "steps")
    suffix = F.regexp_extract(F.expr(f"right(s, {k})"), "([ACGT]*)$", 1)
    frontier = cut(sides.select("node_id", "rev", F.lit(0).alias("past"), suffix.alias("ctx")).where("ctx <> ''"), "front")
    seen = frontier
    while not frontier.isEmpty():
        met = frontier.join(steps, (frontier.node_id == steps.from_node) & (frontier.rev == steps.from_rev))
        taken = met.withColumn("room", F.lit(k) - F.col("past")).withColumn("part", F.substring("head", F.lit(1), F.col("room").cast("int")))
        valid = taken.withColumn("good", F.regexp_extract("part", "^([ACGT]*)", 1))
        grown = cut(valid.select(F.col("to_node").alias("node_id"), F.col("to_rev").alias("rev"), (F.col("past") + F.length("good")).cast("int").alias("past"), F.concat("ctx", "good").alias("text"), (~F.col("more") & (F.length("good") == F.length("head"))).alias("whole")), "grown")
        found.append(grown.select(F.col("text").alias("run")).distinct())
        nxt = grown.where(F.col("whole") & (F.col("past") < k)).select("node_id", "rev", "past", F.expr(f"right(text, {k})").alias("ctx")).distinct()
        frontier = cut(nxt.join(seen, ["node_id", "rev", "past", "ctx"], "left_anti"), "front")
        seen = seen.union(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.where(F.length("run") >= k)


def from_topology(g: Graph, k: int) -> DeBruijn:
    """The graph of all k-mers that any walk spells, whether a path takes it or not."""
    check_k(k)
    return from_texts(topology_runs(g, k), "run", k)
