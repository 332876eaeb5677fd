"""Exact parts of a Jaccard join of sets: prefixes that similar sets must share, and bounds of what two sets share.

All sets are put in one order, hashes that many sets hold last. Of two sets with Jaccard similarity s
or more, each holds a common hash among its first n - ceil(s n) + 1, so the pair meets in the run of that hash.
At the first hash that both hold, sizes and positions bound the overlap; counts by hash bucket bound it again.
Neither bound is ever too low, so no pair that reaches the similarity is left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.llm.exact_dedup import held_by

#: What rounding of similarity times size may come to.
SLACK = 1e-9
#: Runs with more members are compared by their differences from what most of them hold.
RUN = 16
#: Members of a run, at most, that tell what most of them hold. Any set would do; this one makes differences short.
TELLERS = 32
_WORD, _MIX = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Hashes below this are counted, over all sets: a prefix takes a fifth, and seldom needs more than these.
COUNTED = np.uint64(int(0.4 * 2**64))
#: Levels of counts; hashes that are not counted come after the first ``UNCOUNTED`` levels.
LEVELS, UNCOUNTED = (3, 8, 32, 128, 1024), 2
#: Levels of counts among sets that are compared by differences, where all hashes are counted.
NEAR_LEVELS = (2, 3, 4, 6, 10, 20, 50, 200, 1000)
#: Bits of each level's array, at most (8 MB).
LEVEL_BITS = 1 << 26


def ranks(h: np.ndarray, often: list[np.ndarray | None]) -> np.ndarray:
    """How late each hash comes in the order: counted ones by how many levels of ``often`` (bit arrays) hold them, the others between.

    Any function of the hash alone gives an order in which no pair is missed; this one puts what many sets
    hold last.
    """
    rank = np.where(h < COUNTED, 0, 2 * UNCOUNTED - 1)
    low = h < COUNTED
    for array in often:
        if array is not None:
            rank[low] += 2 * held_by(array, h[low])
    return rank


def prefix(h: np.ndarray, often: list[np.ndarray | None], similarity: float) -> np.ndarray:
    """The first hashes of the ascending distinct ``h``, ordered by rank and value."""
    h = h[np.argsort(ranks(h, often), kind="stable")]
    return h[: len(h) - int(np.ceil(similarity * len(h) - SLACK)) + 1]


def may_reach(x: str, y: str, similarity: float) -> Column:
    """Whether two rows with ``pos`` and ``n``, first met at this hash, may still reach the similarity."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return most >= F.lit(similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n") - most) - SLACK


def sketch(h: np.ndarray) -> bytes:
    """How many of the hashes fall into each of about a quarter as many buckets; empty if a count has no room."""
    bits = max(4, (len(h) >> 2).bit_length())
    count = np.bincount((h & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def shared_at_most(x: bytes, y: bytes, m: int, n: int) -> int:
    """An upper bound of the hashes that sets of m and n hashes with these sketches share."""
    if not x or not y:
        return min(m, n)
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) > len(b):
        a = a.reshape(-1, len(b)).sum(0, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """The hashes that more than half of the ascending distinct ``sets`` hold, ascending."""
    h, times = np.unique(np.concatenate(sets), return_counts=True)
    return h[2 * times > len(sets)]


def difference_keys(x: np.ndarray, core: np.ndarray, width: int, name: int, often: list[np.ndarray | None], similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of which two similar sets share one, unless they are :func:`surely_similar`, for a set x of the run ``name``.

    ``core`` may be any set, the same one for the whole run. Also each key's place in the difference from it,
    and the size of that. Hashes come in the order of how many differences hold them, about: what x adds by the
    levels of ``often`` (bit arrays of what several of the compared sets hold), then what it lacks.

    With D(x) the hashes that only one of x and core holds, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    hashes. Similar sets differ in t at most, so their differences share (|D(x)| + |D(y)| - t) / 2 or more: a
    part so large that prefixes of the differences are short. As that depends on the size of both, there is a
    prefix for each class (``width`` sizes) of the other's size; none for classes that are surely similar.
    Copies that were changed in different places share no key, however many there are, if core is as most of
    them are: a member for core would put its own changes into every difference.
    """
    d = np.setxor1d(x, core, assume_unique=True)
    times = np.zeros(len(d), np.int64)
    for array in often:
        if array is not None:
            times += held_by(array, d)
    own = np.isin(d, core, assume_unique=True)
    d = d[np.lexsort((np.where(own, -times, times), own))]
    size, n = len(d), len(x)
    at = np.arange(size)
    part = (1 - similarity) / (1 + similarity)
    t, sure = part * (n + n / similarity) + SLACK, part * (n + n * similarity) - SLACK
    of, out, places = size // width, [], []
    for other in range(int(max(0.0, size - t)) // width, int(size + t) // width + 1):
        share = max(1, int(np.ceil((size + max(other * width, size - t) - t) / 2 - SLACK)))
        if share <= size and size + (other + 1) * width - 1 > sure:
            a, b = min(of, other), max(of, other)
            places.append(at[: size - share + 1])
            out.append((d[: size - share + 1] ^ np.uint64(name * _MIX[0] & _WORD)) * np.uint64(_MIX[1]) + np.uint64((a << 32 | b) * _MIX[2] & _WORD))
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([at[:0], *places]), size


def difference_excess(size: Column, n: Column, similarity: float) -> Column:
    """Two sets are similar for sure if this, of their sizes and those of their differences from one set, sums up to 0 or less."""
    return size - F.lit((1 - similarity) / (1 + similarity)) * n


def surely_similar(x: str, y: str, similarity: float) -> Column:
    """Whether the differences of two rows are so small together that x and y are similar, whatever they share.

    The row of least excess in a run is so with each row that is so with any other: these pairs make one star.
    """
    return difference_excess(F.col(f"{x}.size"), F.col(f"{x}.n"), similarity) + difference_excess(F.col(f"{y}.size"), F.col(f"{y}.n"), similarity) <= SLACK


def may_reach_by_difference(x: str, y: str, similarity: float) -> Column:
    """Whether two rows with ``pos`` and ``size`` in the difference from one set, and ``n``, may still reach the similarity."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    least = (a("size") + b("size") - F.lit((1 - similarity) / (1 + similarity)) * (a("n") + b("n"))) / 2
    return F.least(a("size") - a("pos"), b("size") - b("pos")) >= least - SLACK
