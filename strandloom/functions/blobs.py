"""Arrays in rows: a large table as compressed columns, and parts of them sent to the part that owns them.

Rows are ``(part, kind, n, data)``. A part is small enough for one task; what it gets is put in order by its
function, so that the order of arrival does not matter.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "part int, kind int, n long, data binary"
#: Rows that are handed to the JVM at once.
ROWS = 1 << 16
Row = tuple[int, int, int, bytes]
Kinds = dict[int, list[np.ndarray]]


def pack(*arrays: np.ndarray) -> bytes:
    """Ascending integers as differences, all numbers byte by byte, compressed."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        rising = a.dtype.kind in "iu" and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        head.append(struct.pack("<8sQ?", a.dtype.str.encode(), len(a), rising))
        bits = np.ascontiguousarray(a)
        if rising:
            bits = bits.copy()
            bits[1:] -= a[:-1]
        body.append(bits.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = b"".join(head + body)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", data)
    raw = pa.decompress(memoryview(data)[8:], size, codec="zstd")
    (n,) = struct.unpack_from("<I", raw)
    at, fields, out = 4, [], []
    for _ in range(n):
        fields.append(struct.unpack_from("<8sQ?", raw, at))
        at += struct.calcsize("<8sQ?")
    for name, length, rising in fields:
        t = np.dtype(name.rstrip(b"\0").decode())
        planes = np.frombuffer(raw, np.uint8, length * t.itemsize, at).reshape(t.itemsize, length)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(t)
        if rising:
            a = np.cumsum(a, dtype=t)
        out.append(a)
        at += length * t.itemsize
    return out


def _rows(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    for part, kind, n, data in rows:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "kind", "n", "data"])


def together(blobs: list[bytes]) -> list[np.ndarray]:
    """Blobs of the same columns, end to end."""
    all_ = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*all_, strict=True)]


def deal(kind: int, at: np.ndarray, *columns: np.ndarray) -> Iterator[Row]:
    """Rows for the parts ``at``, which ascend."""
    if len(at):
        edges = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(at[a]), kind, int(b - a), pack(*(c[a:b] for c in columns))


def each_batch(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[Row]]) -> DataFrame:
    """Rows that ``f`` makes of the batches of ``df``."""
    return df.mapInArrow(lambda batches: _rows(f(batches)), SCHEMA)


def each_part(rows: DataFrame, parts: int, f: Callable[[int, Kinds], Iterable[Row]]) -> DataFrame:
    """Rows that ``f(part, columns by kind)`` makes of all that each part got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[bytes]]] = {}
        for b in batches:
            for part, kind, data in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                held.setdefault(part, {}).setdefault(kind, []).append(data)
        for part in sorted(held):
            kinds = held.pop(part)
            yield from _rows(f(part, {k: together(kinds.pop(k)) for k in list(kinds)}))

    return rows.select("part", "kind", "n", "data").repartitionById(parts, rows["part"]).mapInArrow(run, SCHEMA)


def each_row(rows: DataFrame, schema: str, f: Callable[[int, list[np.ndarray]], Iterable[list[pa.Array]]]) -> DataFrame:
    """A plain table of the columns that ``f(part, columns)`` makes of each row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                for columns in f(part, unpack(data)):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def slices(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + ROWS)) for i in range(0, n, ROWS))


def starts_of(rows: DataFrame, parts: int) -> np.ndarray:
    """The running sum of ``n`` by part, from 0: ``parts`` + 1 numbers."""
    n = np.zeros(parts, np.int64)
    for part, count in rows.groupBy("part").agg({"n": "sum"}).collect():
        n[part] = count
    return np.r_[0, np.cumsum(n)]


def part_of(starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts[1:], ids, "right")
