"""Compaction of de Bruijn graphs into unitigs, by pointer doubling over k-mer sides.

A side is ``node_id * 2 + is_rev``; its mirror is the side with the last bit flipped. Chains are found in
both directions at once; a chain and its mirror are one unitig, spelled so that its least node is forward.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import blobs
from strandloom.functions.packed import bases, keys, other_strand, parts_of, signed, words_after
from strandloom.operators.components import connected_components
from strandloom.operators.dbg import DeBruijn, word_part
from strandloom.operators.model import DeBruijnError, Graph, dense_rank_of
from strandloom.plans.runtime import cut, discard

# Kinds of rows.
KMERS, BLOCKED, STATE, MESSAGES, FOUND, MEMBERS, WHOLE = range(7)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Bases of unitigs that are handed to the JVM at once, about.
SPELLED = 1 << 23


@dataclass(frozen=True)
class Unitigs:
    """unitigs(unitig_id, seq), edges(from_id, from_rev, to_id, to_rev, overlap), placement(node_id, unitig_id, offset, is_rev)."""

    k: int
    unitigs: DataFrame
    edges: DataFrame
    placement: DataFrame

    def graph(self) -> Graph:
        spark = self.unitigs.sparkSession
        keyed = self.edges.withColumn("key", F.struct("from_id", "from_rev", "to_id", "to_rev"))
        indexed = dense_rank_of(keyed, "key", "edge_idx", F.shiftright("from_id", 12)).select("edge_idx", F.col("from_id").alias("from_node"), "from_rev", F.col("to_id").alias("to_node"), "to_rev", "overlap")
        return Graph(self.unitigs.select(F.col("unitig_id").alias("node_id"), "seq", F.lit(None).cast("string").alias("name")), indexed, spark.createDataFrame([], "path_idx long, name string, overlaps array<long>"), spark.createDataFrame([], "path_idx long, pos long, node_id long, is_rev boolean"), has_names=False)


def _halves(key: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether k-mers are palindromes, and the bits of what follows on both strands, a row each."""
    pair = parts_of(key, k)
    other = other_strand(*pair, k)
    return (pair[0] == other[0]) & (pair[1] == other[1]), np.stack([mask & 15, mask >> 4])


_COUNT = np.array([bin(i).count("1") for i in range(16)], np.int64)


def side_degrees(d: DeBruijn) -> DataFrame:
    """``(side, n)``: the distinct sides that follow each side which has any.

    A palindromic k-mer is left on both strands alike and always entered forward.
    """
    k, starts = d.k, d.starts

    def rows(part, columns):
        for s in blobs.slices(len(columns[0])):
            _, after = _halves(columns[0][s], columns[1][s], k)
            n = _COUNT[after.T.ravel()]
            at = np.flatnonzero(n)
            yield [pa.array(at + 2 * (s.start + starts[part])), pa.array(n[at])]

    return blobs.each_row(d.held, "side long, n long", rows)


def _of_sides(sides: DataFrame, starts: np.ndarray, kind: int) -> DataFrame:
    """Longs of a table, whose first column is a side, as rows for the parts of the sides."""

    def run(batches):
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            at = blobs.part_of(starts, columns[0] >> 1)
            order = np.argsort(at, kind="stable")
            yield from blobs.deal(kind, at[order], *(c[order] for c in columns))

    return blobs.each_batch(sides, run)


def _joined(d: DeBruijn, blocked_after: DataFrame | None = None) -> DataFrame:
    """Rows of sides ``(x, z)``: z mirrored is the only way on from x and x the only way into it.

    Palindromes and blocked sides end chains. Both ends name the (k+1)-mer between them, and meet in its part.
    """
    k, starts, bounds = d.k, d.starts, d.bounds

    def named(part, key, mask, blocked):
        same, after = _halves(key, mask, k)
        one = (_COUNT[after] == 1) & ~same
        sides = blocked - 2 * starts[part]
        one[sides & 1, sides >> 1] = False
        alone = np.where(one[0], mask & 15, 0) | np.where(one[1], mask & 240, 0)
        found = list(words_after(key, alone.astype(np.uint8), k))
        for end in (0, 1):
            word = np.concatenate([x[2][x[3 + end]] for x in found])
            side = np.concatenate([x[1][x[3 + end]] * 2 + x[0] for x in found]) + 2 * starts[part]
            order = np.argsort(word, kind="stable")
            yield from blobs.deal(end, word_part(bounds, word[order], k), word[order], side[order])

    def met(part, kinds):
        if len(kinds) == 2:
            (a, x), (b, z) = kinds[0], kinds[1]
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            x, z = x[i], z[j]
            other = x >> 1 != z >> 1
            yield part, MESSAGES, int(other.sum()), blobs.pack(x[other], z[other])

    none = np.zeros(0, np.int64)
    if blocked_after is None:

        def out(batches):
            for b in batches:
                for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                    yield from named(part, *blobs.unpack(data), none)

        ends = blobs.each_batch(d.held, out)
    else:
        tied = d.held.union(_of_sides(blocked_after.select("side"), starts, BLOCKED))
        ends = blobs.each_part(tied, d.parts, lambda part, kinds: named(part, *kinds[KMERS], kinds.get(BLOCKED, [none])[0]))
    return blobs.each_part(ends, d.parts, met)


def joins(d: DeBruijn, blocked_after: DataFrame | None = None) -> DataFrame:
    """``(x, y)``: y is the only way on from x and x the only way into y; palindromes and blocked sides end chains.

    ``blocked_after`` (side): nothing follows this side; its mirror has nothing before.
    """

    def rows(part, columns):
        x, z = columns
        for s in blobs.slices(len(x)):
            yield [pa.array(np.r_[x[s], z[s]]), pa.array(np.r_[z[s] ^ 1, x[s] ^ 1])]

    return blobs.each_row(_joined(d, blocked_after), "x long, y long", rows)


def _pushed(part: int, kinds: blobs.Kinds, starts: np.ndarray, reach: int) -> Iterator[blobs.Row]:
    """A round of doubling: messages taken, pointers of ``reach`` steps passed on, nodes with both heads known let go.

    A node holds for both its sides the side before it by ``reach`` steps, or the chain's head where that is
    nearer: ``(v, p0, p1, d0, d1, done0, done1)``, p -1 at a head. It tells the side that is ``reach`` steps on.
    """
    to, value, dist, done = kinds.get(MESSAGES, [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)])
    if STATE in kinds:
        v, p0, p1, d0, d1, e0, e1 = kinds[STATE]
        order = np.argsort(v)
        v, p, d, e = v[order], np.stack([p0, p1])[:, order], np.stack([d0, d1])[:, order], np.stack([e0, e1])[:, order]
    elif reach > 1:
        return
    else:
        v = np.unique(to >> 1)
        p, d, e = np.full((2, len(v)), -1), np.zeros((2, len(v)), np.int64), np.ones((2, len(v)), bool)
    at = np.searchsorted(v, to >> 1)
    # those that are gone knew their heads
    here = at < len(v)
    here[here] = v[at[here]] == to[here] >> 1
    at, side, value, dist, done = at[here], to[here] & 1, value[here], dist[here], done[here]
    head = value < 0
    e[side[head], at[head]] = True
    at, side, value, dist, done = (c[~head] for c in (at, side, value, dist, done))
    p[side, at], d[side, at], e[side, at] = value, d[side, at] + dist, done
    for s in (0, 1):
        far = np.flatnonzero((p[1 - s] >= 0) & (d[1 - s] == reach))
        told = p[1 - s, far] ^ 1
        order = np.argsort(told)
        told, far = told[order], far[order]
        yield from blobs.deal(MESSAGES, blobs.part_of(starts, told >> 1), told, p[s, far], d[s, far], e[s, far])
    gone = e[0] & e[1]
    own = np.where(p < 0, v * 2 + np.array([[0], [1]]), p)
    if gone.any():
        yield part, FOUND, int(gone.sum()), blobs.pack(v[gone], *own[:, gone], *d[:, gone])
    if not gone.all():
        rest = ~gone
        yield part, STATE, int((~e[:, rest]).sum()), blobs.pack(v[rest], *p[:, rest], *d[:, rest], *e[:, rest])


def _doubled(messages: DataFrame, starts: np.ndarray) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows of the nodes on chains, and the state of those on cycles; ``messages`` name for each side the one before it.

    Chains whose heads are known leave, so that later rounds see the long ones only. Of cycles nothing ever
    leaves; where a round brings no head, nothing else is left.
    """
    parts, reach, rounds, live = len(starts) - 1, 1, [], None
    now = messages
    while True:
        step = reach
        now = cut(blobs.each_part(now, parts, lambda part, kinds, step=step: _pushed(part, kinds, starts, step)), "double")
        rounds.append(now)
        was, live = live, now.where(f"kind = {STATE}").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if not live or live == was:
            return rounds, now.where(f"kind = {STATE}") if live else None
        now = now.where(f"kind <> {FOUND}")
        reach *= 2


def chains(d: DeBruijn, blocked_after: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Rows ``(v, h0, h1, d0, d1)`` of all nodes that are joined to others: heads of the chains of both sides and steps from them; what to discard."""
    starts = d.starts

    def before(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                x, z = blobs.unpack(data)
                to, value = np.r_[z, x] ^ 1, np.r_[x, z]
                order = np.argsort(to)
                to, value = to[order], value[order]
                yield from blobs.deal(MESSAGES, blobs.part_of(starts, to >> 1), to, value, np.ones(len(to), np.int64), np.zeros(len(to), bool))

    links = cut(_joined(d, blocked_after), "links")
    rounds, cyclic = _doubled(blobs.each_batch(links, before), starts)
    if cyclic is not None:
        # open each cycle before its least node forward, and its mirror likewise
        ring = cut(blobs.each_row(cyclic, "node long", lambda part, columns: iter([[pa.array(columns[0])]])), "ring")
        pairs = blobs.each_row(links, "x long, z long", lambda part, columns: ([pa.array(c[s]) for c in columns] for s in blobs.slices(len(columns[0]))))
        pairs = cut(pairs.join(ring, F.shiftright("x", 1) == F.col("node"), "left_semi"), "ring")
        least = connected_components(pairs.select(F.shiftright("x", 1).alias("src"), F.shiftright("z", 1).alias("dst"))).select((F.col("component") * 2).alias("y")).distinct()
        # the pair that enters the least node forward has its mirror at one end
        shut = least.select(F.col("y").bitwiseXOR(F.lit(1).cast("long")).alias("end"))
        kept = pairs.join(shut, F.col("x") == F.col("end"), "left_anti").join(shut, F.col("z") == F.col("end"), "left_anti")
        told = kept.select(F.explode(F.array(F.struct(F.col("z").alias("s"), F.col("x").alias("p")), F.struct(F.col("x").alias("s"), F.col("z").alias("p")))).alias("m")).select(F.col("m.s").bitwiseXOR(F.lit(1).cast("long")).alias("s"), "m.p", F.lit(1).cast("long").alias("one"))
        opened, rest = _doubled(_with_flag(_of_sides(told, starts, MESSAGES)), starts)
        if rest is not None:
            raise DeBruijnError("a circular chain could not be opened")
        rounds += opened
    found = rounds[0]
    for x in rounds[1:]:
        found = found.union(x)
    return found.where(f"kind = {FOUND}"), [links, *rounds]


def _with_flag(messages: DataFrame) -> DataFrame:
    """Messages whose pointers are not at a head yet, for all that is known."""

    def run(batches):
        for b in batches:
            for part, n, data in zip(*(b.column(c).to_pylist() for c in ("part", "n", "data")), strict=True):
                yield part, MESSAGES, n, blobs.pack(*blobs.unpack(data), np.zeros(n, bool))

    return blobs.each_batch(messages, run)


def _members(part: int, kinds: blobs.Kinds, starts: np.ndarray) -> Iterator[blobs.Row]:
    """Nodes for the part of their chain's name, the lesser of its two heads; nodes that stand alone are whole."""
    key, mask = kinds[KMERS]
    alone = np.ones(len(key), bool)
    if FOUND in kinds:
        v, h0, h1, d0, d1 = kinds[FOUND]
        rev = h1 < h0
        name, off = np.where(rev, h1, h0), np.where(rev, d1, d0)
        order = np.lexsort((off, name))
        at = (v - starts[part])[order]
        alone[at] = False
        name = name[order]
        yield from blobs.deal(MEMBERS, blobs.part_of(starts, name >> 1), name, off[order], v[order], rev[order], key[at], mask[at])
    at = np.flatnonzero(alone)
    if len(at):
        yield part, WHOLE, len(at), blobs.pack(at + starts[part], np.ones(len(at), np.int64), at + starts[part], np.zeros(len(at), bool), key[at], mask[at])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _ordered(rep: np.ndarray, sizes: np.ndarray, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Unitigs by their least nodes."""
    order = np.argsort(rep, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    at = np.repeat(first, sizes) + _within(sizes)
    return rep[order], sizes, [m[at] for m in members]


def _turned(part: int, kinds: blobs.Kinds, starts: np.ndarray) -> Iterator[blobs.Row]:
    """Chains, read so that the least node is forward, for the part of that node."""
    name, off, v, rev, key, mask = kinds[MEMBERS]
    order = np.lexsort((off, name))
    name, v, rev, key, mask = (c[order] for c in (name, v, rev, key, mask))
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    sizes = np.diff(np.r_[first, len(name)])
    rep = np.minimum.reduceat(v, first)
    flip = np.repeat(rev[v == np.repeat(rep, sizes)], sizes)
    inside, start, length = _within(sizes), np.repeat(first, sizes), np.repeat(sizes, sizes)
    at = start + np.where(flip, length - 1 - inside, inside)
    rep, sizes, members = _ordered(rep, sizes, [v[at], rev[at] ^ flip, key[at], mask[at]])
    to = blobs.part_of(starts, rep)
    ends = np.r_[0, np.cumsum(sizes)]
    edges = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(to[a]), WHOLE, int(b - a), _packed(rep[a:b], sizes[a:b], [m[ends[a] : ends[b]] for m in members])


def _packed(rep, sizes, members) -> bytes:
    return blobs.pack(rep, sizes, *members)


def _whole(part: int, kinds: blobs.Kinds) -> Iterator[blobs.Row]:
    rep, sizes, members = _ordered(kinds[WHOLE][0], kinds[WHOLE][1], kinds[WHOLE][2:])
    yield part, WHOLE, len(rep), _packed(rep, sizes, members)


def _runs(sizes: np.ndarray, each: int, most: int) -> Iterator[tuple[slice, slice]]:
    """Unitigs and their members in runs of ``most`` bases, about."""
    ends = np.r_[0, np.cumsum(sizes)]
    weight = np.cumsum(sizes + each)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + most, "right")))
        yield slice(a, b), slice(int(ends[a]), int(ends[b]))
        a = b


def compact(d: DeBruijn, blocked_after: DataFrame | None = None) -> Unitigs:
    """Maximal unbranched chains; ids by the rank of their least node."""
    k, starts, parts, bounds = d.k, d.starts, d.parts, d.bounds
    found, spent = chains(d, blocked_after)
    members = cut(blobs.each_part(d.held.union(found), parts, lambda part, kinds: _members(part, kinds, starts)), "members")
    discard(*spent)
    turned = blobs.each_part(members.where(f"kind = {MEMBERS}"), parts, lambda part, kinds: _turned(part, kinds, starts))
    held = cut(blobs.each_part(members.where(f"kind = {WHOLE}").union(turned), parts, _whole), "unitigs")
    discard(members)
    ids = blobs.starts_of(held, parts)

    def placement(part, columns):
        _, sizes, v, rev, *_ = columns
        u = np.repeat(np.arange(len(sizes)), sizes) + ids[part]
        off = _within(sizes)
        for s in blobs.slices(len(v)):
            yield [pa.array(v[s]), pa.array(u[s]), pa.array(off[s]), pa.array(rev[s])]

    def seqs(part, columns):
        _, sizes, _, rev, key, _ = columns
        for us, ms in _runs(sizes, k, SPELLED):
            n, r = sizes[us], rev[ms]
            pair = parts_of(key[ms], k)
            pair = tuple(np.where(r, b, a) for a, b in zip(pair, other_strand(*pair, k), strict=True))
            off = _within(n)
            ends = np.r_[0, np.cumsum(n + k - 1)]
            at = np.repeat(ends[:-1], n) + off + k - 1
            out = np.empty(ends[-1], np.uint8)
            out[at] = _LETTERS[(pair[1] & np.uint64(3)).astype(np.int64)]
            head = off == 0
            out[ends[:-1, None] + np.arange(k)] = _LETTERS[bases(signed(pair[0][head]), signed(pair[1][head]), k)]
            text = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast("string")
            yield [pa.array(np.arange(us.start, us.stop) + ids[part]), text]

    def exits(batches):
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                _, sizes, _, rev, key, mask = blobs.unpack(data)
                last = np.cumsum(sizes) - 1
                first, u = last - sizes + 1, np.arange(len(sizes)) + ids[part]
                found = []
                # out of the last node as it lies, and of the first one's other strand
                for back, at in ((False, last), (True, first)):
                    same, _ = _halves(key[at], mask[at], k)
                    side = rev[at] ^ back
                    # a palindrome is left on both strands alike: once here, on both where its words meet
                    bits = np.where(same, 0 if back else mask[at], np.where(side, mask[at] & 240, mask[at] & 15)).astype(np.uint8)
                    found += [(*x, back, same) for x in words_after(key[at], bits, k)]
                for end in (0, 1):
                    word = np.concatenate([x[2][x[3 + end]] for x in found])
                    at = np.concatenate([x[1][x[3 + end]] for x in found])
                    back = np.concatenate([np.full(int(x[3 + end].sum()), x[5]) for x in found])
                    same = np.concatenate([x[6][x[1][x[3 + end]]] for x in found])
                    order = np.argsort(word, kind="stable")
                    yield from blobs.deal(end, word_part(bounds, word[order], k), word[order], u[at[order]], back[order], same[order])

    def crossed(part, kinds):
        (a, u, r, up), (b, v, q, vp) = kinds[0], kinds[1]
        x, y = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        u, r, up, v, q, vp = u[x], r[x], up[x], v[y], ~q[y], vp[y]
        # of two palindromes that meet, the one is not entered backwards from the other's forward strand
        found = [(u, r, v, q & ~(up & vp))]
        found += [(u[up], ~r[up], v[up], np.where(vp, True, q)[up])] if up.any() else []
        found += [(u[vp], np.where(up, True, r)[vp], v[vp], ~q[vp])] if vp.any() else []
        u, r, v, q = (np.concatenate(c) for c in zip(*found, strict=True))
        swap = (v < u) | ((v == u) & (~q < r))
        yield part, 0, len(u), blobs.pack(np.where(swap, v, u), np.where(swap, ~q, r), np.where(swap, u, v), np.where(swap, ~r, q))

    def edges(part, columns):
        for s in blobs.slices(len(columns[0])):
            yield [*(pa.array(c[s]) for c in columns), pa.array(np.full(len(columns[0][s]), k - 1))]

    met = blobs.each_row(blobs.each_part(blobs.each_batch(held, exits), parts, crossed), "from_id long, from_rev boolean, to_id long, to_rev boolean, overlap long", edges)
    return Unitigs(k, blobs.each_row(held, "unitig_id long, seq string", seqs), met if k % 2 else met.distinct(), blobs.each_row(held, "node_id long, unitig_id long, offset long, is_rev boolean", placement))
