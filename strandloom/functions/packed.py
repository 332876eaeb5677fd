"""k-mers as two longs, 2 bits a base: ``l`` the last 32 bases and ``h`` those before, both ordered like the strings.

Whole texts are coded at once: windows by doubling, reverse complements as windows of the turned text, and
windows over gaps by a running count of what is no base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The top bit is flipped, so that signed longs sort like unsigned ones.
_SIGN = np.uint64(1 << 63)
_CODES = np.full(256, 4, np.uint8)
_CODES[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Bases that are coded at once, about.
BLOCK = 1 << 20


def _stack(codes: np.ndarray, w: int) -> np.ndarray:
    """The number that each window of ``w`` codes (32 at most) writes, first code first."""
    n = len(codes) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, size, out, have = codes.astype(np.uint64), 1, np.zeros(n, np.uint64), 0
    while True:
        if w & size:
            # the bits of w, lowest first: this part stands before what is there
            out |= part[w - have - size : w - have - size + n] << np.uint64(2 * have)
            have += size
        if 2 * size > w:
            return out
        part = (part[:-size] << np.uint64(2 * size)) | part[size:]
        size *= 2


def _pairs(codes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    low = min(w, 32)
    n = max(0, len(codes) - w + 1)
    return (_stack(codes, w - 32)[:n] if w > 32 else np.zeros(n, np.uint64)), _stack(codes, low)[w - low : w - low + n]


def windows(text: bytes, w: int) -> tuple[np.ndarray, ...]:
    """Of each window of ``w`` characters: canonical ``h`` and ``l``, whether that is the other strand, whether it is both, and whether all are bases."""
    codes = _CODES[np.frombuffer(text, np.uint8)]
    gaps = np.r_[0, np.cumsum(codes == 4)]
    codes &= 3
    h, l = _pairs(codes, w)
    oh, ol = (x[::-1] for x in _pairs(3 - codes[::-1], w))
    turned = (oh < h) | ((oh == h) & (ol < l))
    good = gaps[w:] == gaps[:-w] if len(gaps) > w else np.zeros(0, bool)
    return np.where(turned, oh, h), np.where(turned, ol, l), turned, (oh == h) & (ol == l), good


def signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _SIGN).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64) ^ _SIGN


def bases(h: np.ndarray, l: np.ndarray, k: int) -> np.ndarray:
    """Codes of k-mers (signed columns), one row each."""
    h, l = unsigned(h), unsigned(l)
    low = min(k, 32)
    out = np.empty((len(l), k), np.uint8)
    for i in range(low):
        out[:, k - 1 - i] = (l >> np.uint64(2 * i)) & np.uint64(3)
    for i in range(k - low):
        out[:, k - low - 1 - i] = (h >> np.uint64(2 * i)) & np.uint64(3)
    return out


def texts(h: np.ndarray, l: np.ndarray, k: int) -> np.ndarray:
    letters = _LETTERS[bases(h, l, k)]
    return np.ascontiguousarray(letters).view(f"S{k}").ravel().astype(str) if len(letters) else np.zeros(0, str)


def kmer_text(k: int) -> Column:
    """The k-mer of the columns ``h`` and ``l`` as a string."""

    @F.pandas_udf("string")
    def spelled(h: pd.Series, l: pd.Series) -> pd.Series:
        return pd.Series(texts(h.to_numpy(), l.to_numpy(), k))

    return spelled("h", "l")


def joined(values: list[bytes]) -> Iterator[bytes]:
    """Texts end to end with a gap between, about ``BLOCK`` bytes at once; longer texts go alone."""
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v) + 1
        if size >= BLOCK:
            yield b"-".join(held)
            held, size = [], 0
    if held:
        yield b"-".join(held)


def keys(h: np.ndarray, l: np.ndarray, w: int) -> np.ndarray:
    """One sortable value for each word of ``w`` bases (unsigned): a long, or both as 16 bytes."""
    return l if w <= 32 else np.ascontiguousarray(np.stack([h, l], 1).astype(">u8")).view("S16").ravel()


def parts_of(key: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """``h`` and ``l`` of :func:`keys`."""
    if w <= 32:
        return np.zeros(len(key), np.uint64), key
    both = np.ascontiguousarray(key).view(">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def _turned(x: np.ndarray) -> np.ndarray:
    """The reverse complement of 32 bases."""
    x = ~x
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = ((x >> s) & m) | ((x & m) << s)
    return x.byteswap()


def other_strand(h: np.ndarray, l: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Reverse complements of words of ``w`` bases (unsigned)."""
    if w <= 32:
        return np.zeros(len(l), np.uint64), _turned(l) >> np.uint64(64 - 2 * w)
    top, low, s = _turned(l), _turned(h), 2 * (64 - w)
    return (top >> np.uint64(s), (low >> np.uint64(s)) | (top << np.uint64(64 - s))) if s else (top, low)


def less(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))


def spelled(key: np.ndarray, w: int) -> pa.Array:
    """The words of ``key`` as strings."""
    h, l = parts_of(key, w)
    letters = _LETTERS[bases(signed(h), signed(l), w)]
    return pa.StringArray.from_buffers(len(key), pa.py_buffer((np.arange(len(key) + 1) * w).astype(np.int32)), pa.py_buffer(letters.tobytes()))


#: The bit of a base in half a mask; none for a gap.
_BIT = np.array([1, 2, 4, 8, 0], np.uint8)


def neighbours(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the canonical k-mers of a text, and as masks the bases that follow them.

    Bits 0 to 3 stand for A, C, G, T behind the canonical form, bits 4 to 7 behind the other strand. A
    palindrome has what follows on both strands in both halves.
    """
    codes = _CODES[np.frombuffer(text, np.uint8)]
    h, l, turned, same, good = windows(text, k)
    n = len(good)
    if not n:
        return keys(h, l, k), np.zeros(0, np.uint8)
    after = _BIT[np.r_[codes[k:], np.uint8(4)]][good]
    before = np.r_[np.uint8(4), codes[: n - 1]]
    before = _BIT[np.where(before < 4, 3 - before, 4)][good]
    turned, same = turned[good], same[good]
    mask = np.where(turned, after << 4 | before, before << 4 | after)
    mask = np.where(same, mask | mask << 4 | mask >> 4, mask)
    return keys(h[good], l[good], k), mask


def merged(key: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with all bits of its masks."""
    if 2 * k + 8 <= 64:
        both = key << np.uint64(8) | mask
        both.sort()
        key, mask = both >> np.uint64(8), both.astype(np.uint8)
    else:
        order = np.argsort(key, kind="stable")
        key, mask = key[order], mask[order]
    if not len(key):
        return key, mask
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.bitwise_or.reduceat(mask, first)


def words_after(key: np.ndarray, mask: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of canonical k-mers and masks ``(rev, index, word, first, last)``: the canonical (k+1)-mers on from both strands.

    ``first``: the strand of the k-mer begins the canonical word; ``last``: its other strand ends it. A
    palindrome counts once.
    """
    pair = parts_of(key, k)
    turned = other_strand(*pair, k)
    same = (pair[0] == turned[0]) & (pair[1] == turned[1])
    for rev in (0, 1):
        h, l = turned if rev else pair
        bits = np.where(same, 0, mask >> 4) if rev else mask
        for b in range(4):
            at = np.flatnonzero(bits >> b & 1)
            word = (h[at] << np.uint64(2) | l[at] >> np.uint64(62), l[at] << np.uint64(2) | np.uint64(b))
            if k < 32:
                word = np.zeros(len(at), np.uint64), word[1]
            other = other_strand(*word, k + 1)
            last = ~less(word, other)
            first = ~less(other, word)
            out = np.where(first, word[0], other[0]), np.where(first, word[1], other[1])
            yield rev, at, keys(*out, k + 1), first, last


def ends_of(word: np.ndarray, k: int) -> tuple[tuple, tuple]:
    """Of (k+1)-mers the k-mers at both ends, each as ``(key as read, key of the other strand)``."""
    h, l = parts_of(word, k + 1)
    low = np.uint64((1 << 64) - 1 if k >= 32 else (1 << 2 * k) - 1)
    high = np.uint64(0 if k <= 32 else (1 << 2 * (k - 32)) - 1)
    head = h >> np.uint64(2), (l >> np.uint64(2) | h << np.uint64(62)) & low
    tail = h & high, l & low
    return tuple((keys(*x, k), keys(*other_strand(*x, k), k)) for x in (head, tail))


def placed_kmers(table: DataFrame, k: int) -> DataFrame:
    """Of ``table`` (path_idx, chunk, at, text): ``(path_idx, chunk, at, h, l, is_rev, starts)`` of every gap-free k-mer that follows a character.

    ``at`` is the offset of the text's first character; ``starts``: the character before the k-mer is none of its run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, chunk, at, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                h, l, turned, _, good = windows(data, k)
                keep = np.flatnonzero(good)
                keep = keep[keep > 0]
                n = len(keep)
                before = _CODES[np.frombuffer(data, np.uint8)[keep - 1]] == 4 if n else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, path, np.int64)), pa.array(np.full(n, chunk, np.int64)), pa.array(at + keep), pa.array(signed(h[keep])), pa.array(signed(l[keep])), pa.array(turned[keep]), pa.array(before)], names=["path_idx", "chunk", "at", "h", "l", "is_rev", "starts"])

    return table.select("path_idx", "chunk", "at", F.col("text").cast("binary")).mapInArrow(run, "path_idx long, chunk long, at long, h long, l long, is_rev boolean, starts boolean")
