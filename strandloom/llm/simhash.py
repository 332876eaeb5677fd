"""SimHash near-duplicate detection with covering locality-sensitive hashing.

For radius r the 64 fingerprint bits are mapped onto vectors of GF(2)^(r+1); each non-zero vector v gives
one table whose key keeps the bits i with <phi(i), v> = 1 (32 of 64). The at most r differing bits of a
pair span at most r dimensions, so some v is orthogonal to all of them and the pair meets in that table:
no pair within the radius is missed. 2^(r+1) - 1 tables.

Rows meet per (table, key); a run with more members than ``RUN`` is not compared but dealt again to finer
tables (the free bits cut into r + 1 blocks, one of which must agree), until few free bits are left. Runs
emit a spanning forest of their links (at most members - 1 rows), never all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from strandloom.llm import overlap
from strandloom.llm.exact_dedup import bit_array, held_by, membership_filter, without
from strandloom.operators.components import connected_components
from strandloom.plans.runtime import cut, discard, plain_columns

SEED = 42
#: Runs with more members are dealt to finer tables.
RUN = 2000
#: Hashes that are sent in one row, at most.
PIECE = 2048
#: Bits that the finest tables leave free, at most.
FREE = 14
_LANE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes outside ``[\\x20\\x09-\\x0D]``."""
    return data.lower().split()


def shingle_hashes(tokens: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; the whole sequence if it is shorter."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= k:
        return np.array([h(b" ".join(tokens), SEED)], np.uint64)
    rows = zip(*(tokens[i:] for i in range(k)), strict=False)
    return np.array([h(s, SEED) for s in map(b" ".join, rows)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 17):  # long texts in blocks
        lanes = hashes[at : at + (1 << 17)].astype("<u8").view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
        votes += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    bits = (votes @ _LANE_BITS).reshape(64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_fingerprint(k: int) -> Callable[[bytes], tuple[int, ...]]:
    return lambda data: (majority(shingle_hashes(words(data), k)),)


def signatures(docs: DataFrame, keep: list[str], text: str, of: Callable[[bytes], tuple[int, ...]], names: list[str]) -> DataFrame:
    """The columns ``keep`` and a long for each of ``names``; null texts count as empty."""
    schema = docs.select(*keep).schema
    for n in names:
        schema = schema.add(n, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [tuple(map(signed, of(x or b""))) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [[]] * len(names))], names=[*keep, *names])

    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes_")).mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 bit masks, none empty and no two alike.

    Bit i stands for the vector i mod 2^(radius+1); where 64 numbers do not reach all dimensions, for the
    unit vectors and then fixed random ones. Vectors that span the space give each v a mask of its own.
    """
    size = 1 << (radius + 1)
    rng = random.Random(SEED)
    vectors = [i % size for i in range(64)] if size <= 64 else [1 << i if i <= radius else rng.randrange(1, size) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() & 1) for v in range(1, size)]


def finer(mask: int, radius: int) -> list[int]:
    """``mask`` with one of radius + 1 blocks of its free bits added: of a pair that agrees on mask, one block agrees."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part) for part in (free[j :: radius + 1] for j in range(radius + 1))]


def forest(fp: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning-forest edges (positions) of the graph in which ``linked(i, candidates)`` says who i links to."""
    left = np.arange(len(fp))
    edges: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = linked(i, left)
            if hit.any():
                new = left[hit]
                left = left[~hit]
                edges += [(i, int(j)) for j in new]
                todo += new.tolist()
    return edges


def _runs(radius: int, run_most: int, last: bool):
    """mapInArrow body over rows (t, key, fp, node) sorted by (t, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "a", "b", "fp"]
        held: list[np.ndarray] = []  # columns of the run that the last batch ended in
        over: tuple[int, int] | None = None  # a run that is being handed on to finer tables

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1])], names=names)

        def link(m: np.ndarray) -> np.ndarray:
            fp = m[:, 2].view(np.uint64)
            found = forest(fp, lambda i, js: np.bitwise_count(fp[i] ^ fp[js]) <= radius)
            e = np.array(found, np.int64).reshape(-1, 2)
            rows = np.zeros((len(e), len(names)), np.int64)
            rows[:, 0] = -1
            rows[:, 1], rows[:, 2] = m[e[:, 0], 3], m[e[:, 1], 3]
            return rows

        def handed(m: np.ndarray) -> np.ndarray:
            rows = np.zeros((len(m), len(names)), np.int64)
            rows[:, 0], rows[:, 1], rows[:, 3] = m[:, 0], m[:, 3], m[:, 2]
            return rows

        def close(m: np.ndarray) -> list[np.ndarray]:
            return [link(m)] if len(m) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            made: list[np.ndarray] = []
            if held:
                m = np.concatenate([*held, m])
                held = []
            cuts = np.flatnonzero((m[1:, 0] != m[:-1, 0]) | (m[1:, 1] != m[:-1, 1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(m)]
            size = ends - starts
            if over is not None and (int(m[0, 0]), int(m[0, 1])) == over:
                made.append(handed(m[: ends[0]]))
                starts, ends, size = starts[1:], ends[1:], size[1:]
            if len(starts):
                over = None
                if size[-1] > run_most and not last:
                    part = m[starts[-1] :]
                    over = (int(part[0, 0]), int(part[0, 1]))
                    made.append(handed(part))
                else:
                    held = [m[starts[-1] :].copy()]
                starts, ends, size = starts[:-1], ends[:-1], size[:-1]
            two = starts[size == 2]
            if len(two):  # most runs: all at once
                x, y = m[two], m[two + 1]
                ok = np.bitwise_count((x[:, 2] ^ y[:, 2]).view(np.uint64)) <= radius
                rows = np.zeros((int(ok.sum()), len(names)), np.int64)
                rows[:, 0], rows[:, 1], rows[:, 2] = -1, x[ok, 3], y[ok, 3]
                made.append(rows)
            for i in np.flatnonzero(size > 2):
                part = m[starts[i] : ends[i]]
                made += [handed(part)] if len(part) > run_most and not last else close(part)
            if made and (rows := np.concatenate(made)).size:
                yield out(rows)
        if held and (made := close(np.concatenate(held))):
            yield out(made[0])

    return run


def links(points: DataFrame, radius: int, run_most: int = RUN) -> DataFrame:
    """A spanning set ``(src, dst)`` of all links between the distinct points (node, fp).

    Two points link at ``radius`` or fewer differing bits of fp. Joining the result's components gives
    exactly the components of all links.
    """
    schema = "t long, a long, b long, fp long"
    tables = covering_masks(radius)
    rows = points.select(F.explode(F.expr(f"sequence(0L, {len(tables) - 1}L)")).alias("t"), "fp", "node")
    found = []
    while True:
        free = 64 - min(m.bit_count() for m in tables)
        last = free <= FREE
        # a row's key follows from its table and fingerprint, so it is made on both sides and does not travel
        masks = ", ".join(f"{signed(m)}L" for m in tables)
        key = F.col("fp").bitwiseAND(F.expr(f"element_at(array({masks}), cast(t + 1 as int))"))
        dealt = rows.repartition("t", key).select("t", key.alias("key"), "fp", "node")
        met = cut(dealt.sortWithinPartitions("t", "key").mapInArrow(_runs(radius, run_most, last), schema), "simhash")
        found.append(met.where("t = -1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        again = met.where("t >= 0")
        hot = [] if last else [r.t for r in again.select("t").distinct().collect()]  # table numbers only
        if not hot:
            break
        # only the tables with hot runs go on, numbered anew
        hot = sorted(hot)
        tables = [m for t in hot for m in finer(tables[t], radius)]
        place = F.array_position(F.array(*map(F.lit, hot)), F.col("t")) - 1
        finer_of = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: place * (radius + 1) + j)
        rows = again.select(F.explode(finer_of).alias("t"), "fp", F.col("a").alias("node"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    The fingerprint is 16 hex digits over the shingles of the whole text. component_id is the smallest id
    reachable over links of ``radius`` or fewer differing bits. Null and empty texts have fingerprint
    zero and link like any other. Null ids get a component but are never its id (null only if all ids in
    the component are). Repeated rows and equal texts share a component; an empty table gives no rows;
    further columns of ``docs``, whatever their names, are not looked at.
    """
    narrow = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    fps = cut(signatures(narrow, ["id"], "text", shingle_fingerprint(shingle_words), ["fp"]), "fp")
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")), "fpclass")
    near = connected_components(links(classes.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = classes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(best, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def exact_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``(node, set)`` of texts (node, text): the distinct shingles, ascending, as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [s.tobytes() for s in _shingle_arrays(b.column(1).to_pylist(), shingle_words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["node", "set"])

    return cut(texts.select("node", F.col("text").cast("binary").alias("b")).mapInArrow(sets, "node long, set binary"), "shingles")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose ``sets`` (node, set) have this Jaccard similarity, exactly."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                m, n = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(m, n, assume_unique=True))
                keep.append(both >= similarity * (len(m) + len(n) - both) - overlap.SLACK)
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.toDF("src", "x"), "src").join(sets.toDF("dst", "y"), "dst")
    return cut(met.select("src", "dst", "x", "y").mapInArrow(_released(compare), "src long, dst long"), "links")


_DIFFERENCES = "node long, key long, pos int, size int, n int"


def cores(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(hub, core, width)`` of the runs in ``pairs`` (node, hub): what most of some members hold, and a twentieth of their median size.

    Each of ``overlap.TELLERS`` lots of a run's members gives one of them; the core makes differences short, and
    all members are compared by it.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def close() -> pa.RecordBatch:
            core, width = overlap.common(held).tobytes(), max(1, int(np.median([len(s) for s in held])) // 20)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([core], pa.binary()), pa.array([width], pa.int32())], names=["hub", "core", "width"])

        for b in batches:
            for hub, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and hub != now:
                    yield close()
                now = hub
                held.append(np.frombuffer(s, np.uint64))
        if held:
            yield close()

    tellers = pairs.groupBy("hub", F.pmod(F.xxhash64("node"), F.lit(overlap.TELLERS))).agg(F.min("node").alias("node")).select("hub", "node")
    told = tellers.join(sets, "node").select("hub", "set").repartition("hub").sortWithinPartitions("hub")
    return cut(told.mapInArrow(_released(tell), "hub long, core binary, width int"), "cores")


def difference_keys(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, key, pos, size, n)`` of ``pairs`` (node, hub): see :func:`overlap.difference_keys`; and a row of each pair with pos -1 and the hub as key."""
    often = pairs.sparkSession.sparkContext.broadcast(_levels(sets.select("set"), lambda c: [np.frombuffer(x, np.uint64) for x in c.to_pylist()], overlap.NEAR_LEVELS, (sets.agg(F.sum(F.octet_length("set"))).first()[0] or 0) // 8))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, hub, x, core, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(x, np.uint64)
                made, at, size = overlap.difference_keys(x, np.frombuffer(core, np.uint64), width, hub, often.value, similarity)
                key, pos = np.r_[np.int64(hub), made.view(np.int64)], np.r_[-1, at].astype(np.int32)
                same = lambda v, kind, k=len(key): pa.array(np.full(k, v, kind))
                yield pa.RecordBatch.from_arrays([same(node, np.int64), pa.array(key), pa.array(pos), same(size, np.int32), same(len(x), np.int32)], names=["node", "key", "pos", "size", "n"])

    met = pairs.join(sets.toDF("node", "x"), "node").join(cores(pairs, sets), "hub").select("node", "hub", "x", "core", "width")
    return met.mapInArrow(keys, _DIFFERENCES)


def possible_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (src, dst) that may reach the similarity by their sketches (node, n, sketch): none that does is left out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for m, x, n, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                both = overlap.shared_at_most(x, y, m, n)
                keep.append(both >= similarity * (m + n - both) - overlap.SLACK)
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sketches.toDF("src", "m", "x"), "src").join(sketches.toDF("dst", "n", "y"), "dst")
    return met.select("src", "dst", "m", "x", "n", "y").mapInArrow(compare, "src long, dst long")


def _released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task``, after which the worker, which other stages use again, gives back what Arrow holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


def _shingle_arrays(texts: list[bytes], shingle_words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(words(t), shingle_words)) for t in texts]


def repeated(rows: DataFrame, hashes: Callable[[pa.Array], list[np.ndarray]], least: int, about: int) -> DataFrame:
    """``(h, n)``: the hashes that ``least`` or more of the rows hold, by owners of ranges of hashes.

    ``hashes`` gives the distinct hashes of each row of a column. Batches send each owner its hashes as one
    piece of bytes, so that the JVM moves few rows; an owner counts one range at once. ``about``: the number of
    hashes, of which a range has a million or so.
    """
    bits = max(0, (about >> 20).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.sort(np.concatenate([np.zeros(0, np.uint64), *hashes(b.column(0))]))
            owner = (h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(h) else np.zeros(0, np.int64)
            starts = np.union1d(starts, np.arange(0, len(h), PIECE))  # workers get many pieces at once
            ends = np.r_[starts, len(h)]  # no piece of a batch without hashes
            pieces = [h[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[starts]), pa.array(pieces, pa.binary())], names=["owner", "piece"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def close() -> pa.RecordBatch:
            h, n = np.unique(np.frombuffer(b"".join(held), np.uint64), return_counts=True)
            keep = n >= least
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

        for b in batches:
            for owner, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and owner != now:
                    yield close()
                now = owner
                held.append(piece)
        if held:
            yield close()

    sent = rows.mapInArrow(_released(send), "owner long, piece binary")
    return cut(sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(_released(count), "h long, n long"), "often")


def _levels(rows: DataFrame, hashes: Callable[[pa.Array], list[np.ndarray]], levels: tuple[int, ...], about: int) -> list[np.ndarray | None]:
    """For each level a bit array of the hashes that so many of the rows hold."""
    often = repeated(rows, hashes, min(levels), about)
    arrays = [bit_array(often.where(F.col("n") >= level).select("h"), overlap.LEVEL_BITS) for level in levels]
    discard(often)
    return arrays


def often_held(texts: DataFrame, shingle_words: int) -> list[np.ndarray | None]:
    """For each of ``overlap.LEVELS`` a bit array of the counted shingles that so many of all texts hold."""
    low = lambda c: [s[: np.searchsorted(s, overlap.COUNTED)] for s in _shingle_arrays(c.to_pylist(), shingle_words)]
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _levels(texts.select(F.col("text").cast("binary").alias("b")), low, overlap.LEVELS, size // 15)  # two in five of the words


def shingle_sets(texts: DataFrame, shingle_words: int, similarity: float, often) -> DataFrame:
    """``(id, th, node, fp, n, sketch, prefix)``: node names the set of distinct shingles, fp is its SimHash, n its size.

    ``often``: the broadcast arrays of :func:`often_held`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _shingle_arrays(b.column(2).to_pylist(), shingle_words)
            made = {
                "node": pa.array([signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64()),
                "fp": pa.array([signed(majority(s)) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "sketch": pa.array(map(overlap.sketch, sets), pa.binary()),
                "prefix": pa.array([overlap.prefix(s, often.value, similarity).view(np.int64) for s in sets], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made.values()], names=["id", "th", *made])

    schema = texts.select("id", "th").schema.add("node", "long").add("fp", "long").add("n", "long").add("sketch", "binary").add("prefix", ArrayType(LongType()))
    return texts.select("id", "th", F.col("text").cast("binary").alias("_bytes_")).mapInArrow(_released(run), schema)


def simhash_candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """``(src, dst)`` from ``nodes`` (node, fp): each node with the least of its fingerprint, and those of linked fingerprints."""
    classes = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("members")), "fpclass")
    near = links(classes.select(F.col("fp").alias("node"), "fp"), radius)
    name = classes.select(F.col("fp"), "least")
    between = near.join(name.toDF("src", "a"), "src").join(name.toDF("dst", "b"), "dst").select("a", "b")
    inside = nodes.join(classes.where("members > 1"), "fp").where("node <> least").select("least", "node")
    return between.union(inside).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def prefix_members(sets: DataFrame) -> DataFrame:
    """``(key, node, pos, n)`` of every prefix hash that several sets hold."""
    lists = lambda c: [np.asarray(c.values[o.start : o.stop].to_numpy()).view(np.uint64) for o in _spans(c)]
    often = repeated(sets.select("prefix"), lists, 2, sets.agg(F.sum(F.size("prefix"))).first()[0] or 0)
    array = bit_array(often.select("h"))
    schema = "key long, node long, pos int, n int"
    if array is None:
        return sets.sparkSession.createDataFrame([], schema)
    held = sets.sparkSession.sparkContext.broadcast(array)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a filter of bounded size leaves few hashes that one set alone holds
        for b in batches:
            c, of = b.column(2), _spans(b.column(2))
            key = c.values.to_numpy()[of[0].start : of[-1].stop] if of else np.zeros(0, np.int64)
            count = np.array([len(o) for o in of], np.int64)
            row = np.repeat(np.arange(len(of)), count)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            keep = held_by(held.value, key.view(np.uint64))
            node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[row[keep]]), pa.array(pos[keep].astype(np.int32)), pa.array(n[row[keep]].astype(np.int32))], names=["key", "node", "pos", "n"])

    rows = sets.select("node", "n", "prefix").mapInArrow(spread, schema)
    out = cut(rows.join(often.select(F.col("h").alias("key")), "key").dropDuplicates(["key", "node"]), "members")
    discard(often)
    return out


def _spans(c: pa.Array) -> list[range]:
    """Where the items of each list of a list array lie in its values."""
    at = c.offsets.to_numpy().tolist()
    return [range(a, b) for a, b in zip(at, at[1:], strict=False)]


def near_duplicate_links(members: DataFrame, met: DataFrame, verify: Callable[[DataFrame], DataFrame], differences: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``(node, component)`` of all pairs that ``verify`` passes; nodes without a link are left out.

    ``members`` (key, node, pos, n): prefix hashes that several sets hold; ``met``: candidates by SimHash.
    Of each hash, one member is the hub: the one with most candidates. The first round compares the hubs with
    the others, and ``met``. The second compares members that are in different components still: each with
    each where a hash has few members, else those that share a key of their ``differences`` from what most
    members hold; pairs whose differences are so small that they are similar for sure are linked by a star.
    """
    degree = met.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = cut(members.join(degree, "node", "left").select("key", "node", "pos", "n", F.coalesce("links", F.lit(0).cast("long")).alias("links")), "known")
    hubs = cut(known.groupBy("key").agg(F.max(F.struct("links", "node", "pos", "n")).alias("y"), F.count("*").alias("rows")), "hubs")
    pair = lambda df, a, b: df.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst")
    first = known.alias("x").join(hubs, "key").where((F.col("rows") > overlap.RUN) | overlap.may_reach("x", "y", similarity))
    tested = cut(pair(first, "x.node", "y.node").union(met).distinct(), "pairs")
    linked = verify(tested)
    near = cut(connected_components(linked), "near")
    # of two members one is the hub, so that pair is done
    mains = hubs.where("rows > 2").select("key", "rows", F.col("y.node").alias("hub")).join(near.toDF("hub", "main"), "hub", "left").withColumn("main", F.coalesce("main", "hub"))
    spots = known.drop("links").join(mains, "key").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(spots.select("key", "node", "pos", "n", "component", "rows", "hub", "main"), "placed")
    few, many = placed.where(F.col("rows") <= overlap.RUN), placed.where(F.col("rows") > overlap.RUN)
    apart = (F.col("x.component") != F.col("z.component")) & overlap.may_reach("x", "z", similarity)
    once = (F.col("x.node") < F.col("z.node")) | (F.col("z.component") == F.col("z.main"))
    short = few.where("component <> main").alias("x").join(few.alias("z"), "key").where(once & apart)
    mixed = many.groupBy("key").agg(F.max(F.col("component") != F.col("main")).alias("mixed")).where("mixed").select("key")
    keys = cut(differences(many.join(mixed, "key").where("node <> hub").select("node", "hub").distinct()), "differences")
    shown = lambda df: df.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = cut(shown(keys.where("pos < 0")), "ends")
    centres = ends.groupBy("key").agg(F.min(F.struct(overlap.difference_excess(F.col("size"), F.col("n"), similarity).alias("excess"), "node", "size", "n", "component")).alias("z")).select("key", "z.*")
    star = ends.alias("x").join(centres.alias("z"), "key").where("x.component <> z.component").where(overlap.surely_similar("x", "z", similarity))
    often = keys.where("pos >= 0").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    where = cut(shown(keys.where("pos >= 0").join(often, "key")), "differences")
    unsure = overlap.may_reach_by_difference("x", "z", similarity) & ~overlap.surely_similar("x", "z", similarity)
    long = where.alias("x").join(where.alias("z"), "key").where("x.node < z.node and x.component <> z.component").where(unsure)
    rest = cut(pair(short, "x.node", "z.node").union(pair(star, "x.node", "z.node")).union(pair(long, "x.node", "z.node")).distinct().join(tested, ["src", "dst"], "left_anti"), "pairs")
    more = verify(rest)
    out = cut(connected_components(linked.union(more)), "near")
    discard(known, hubs, tested, linked, near, placed, keys, ends, where, rest, more)
    return out


def near_duplicate_filter(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Groups are the components of all pairs whose distinct ``shingle_words``-word shingles have a Jaccard
    ``similarity`` or more. Covering masks bring together all pairs whose SimHashes over these shingles differ
    by ``radius`` bits or fewer; at 0.8 about ten of 64 bits differ, which no workable number of masks covers,
    so prefix filtering (see ``overlap``) finds the pairs beyond. Every candidate is compared exactly and no
    pair is missed, also none among many copies of one text that are not similar to each other. Texts with no word are never near-duplicates of each other and stay. Rows that repeat
    both id and text stay or go together; null ids come last. Columns are those of ``docs``.
    """
    docs, (id, text), restored = plain_columns(docs, id, text)
    tagged = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    often = docs.sparkSession.sparkContext.broadcast(often_held(tagged, shingle_words))
    sets = cut(shingle_sets(tagged, shingle_words, similarity, often), "sets")
    nodes = cut(sets.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows")), "nodes")

    def sets_of(pairs: DataFrame) -> DataFrame | None:
        """The exact sets of both ends; one text each, and a filter of bounded size lets few other texts through."""
        ends = pairs.select(F.explode(F.array(*pairs.columns)).alias("node")).distinct()
        shown = cut(ends.join(nodes, "node").select("node", F.xxhash64("k.id", "k.th").alias("h")), "ends")
        member = membership_filter(shown.select("h").distinct())
        if member is None:
            return None
        texts = tagged.withColumn("h", F.xxhash64("id", "th")).where(member("h")).select("h", "text").join(shown, "h").select("node", "text").dropDuplicates(["node"])
        found = exact_sets(texts, shingle_words)
        discard(shown)
        return found

    def verify(pairs: DataFrame) -> DataFrame:
        likely = cut(possible_pairs(pairs, nodes.select("node", "n", "sketch"), similarity), "likely")
        held = sets_of(likely)
        if held is None:
            return likely
        found = similar_pairs(likely, held, similarity)
        discard(likely, held)
        return found

    def differences(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "hubpairs")
        held = sets_of(pairs)
        return docs.sparkSession.createDataFrame([], _DIFFERENCES) if held is None else difference_keys(pairs, held, similarity)

    members, met = prefix_members(sets), cut(simhash_candidates(nodes, radius), "met")
    near = near_duplicate_links(members, met, verify, differences, similarity)
    discard(members, met)
    grouped = nodes.join(near, "node", "left").withColumn("root", F.coalesce("component", "node"))
    best = grouped.groupBy("root").agg(F.min("k").alias("best"), F.sum("rows").alias("all")).where("all > 1")
    bad = cut(grouped.join(best, "root").select("node", "best"), "groups")
    gone = sets.select("id", "th", "node").join(bad, "node").where("not (id <=> best.id and th = best.th)")
    gone = cut(gone.select(F.xxhash64("id", "th").alias("h"), F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct(), "gone")
    discard(sets, nodes, bad)
    return restored(without(docs, gone, F.xxhash64(F.col(id), F.xxhash64(F.col(text))), lambda d: d[id].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(d[text]) == gone["_gone_th"])))
