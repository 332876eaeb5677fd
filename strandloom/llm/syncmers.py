"""Document fingerprints from closed syncmers.

A k-mer of characters is chosen if its least inner s-mer (by hash) stands at its first or last place: a
choice that depends on the k-mer alone, so an edit changes only the anchors it touches. The fingerprint
holds anchors with their positions, taken over the whole text: all whose hash is below a fixed share of the
hash values, so that it grows with the text, and the ``kept`` least in any case (``share`` 1 keeps all).
Likeness compares what both fingerprints tell fully, which is the anchors up to the lesser of their last
hashes: the share of those in common that also agree in their shift.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

K, S, KEPT, SHARE = 12, 4, 128, 1 / 16
#: Hash values.
_HASHES = 1 << 32
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of all closed syncmers; of a short text the text itself at 0."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < K:
        h = np.array([n], np.uint64)
        for i in range(n):
            h = _mix(h * _P + c[i : i + 1])
        return (h >> np.uint64(32)).astype(np.int64), np.zeros(1, np.int64)
    m = n - S + 1
    small = c[:m].copy()
    for i in range(1, S):
        small = small * _P + c[i : i + m]
    small = _mix(small)
    inner = K - S + 1
    count = n - K + 1
    least = small[:count].copy()
    for i in range(1, inner):
        np.minimum(least, small[i : i + count], out=least)
    chosen = np.flatnonzero((small[:count] == least) | (small[inner - 1 : inner - 1 + count] == least))
    if not len(chosen):
        chosen = np.array([int(np.argmin(least))])
    h = small[chosen]
    for i in range(S, K - S + 1, S):
        h = _mix(h * _P + small[chosen + i])
    return (h >> np.uint64(32)).astype(np.int64), chosen


def fingerprint(text: str, kept: int = KEPT, share: float = SHARE) -> str:
    """``<number of distinct anchors>|hash@position ...`` in hex, ascending by hash."""
    h, at = anchors(text)
    values, first = np.unique(h, return_index=True)
    n = max(kept, int(np.searchsorted(values, int(share * _HASHES))))
    return f"{len(values):x}|" + " ".join([f"{v:08x}@{p:x}" for v, p in zip(values[:n].tolist(), at[first[:n]].tolist(), strict=True)])


def _read(fp: str) -> tuple[dict[int, int], int]:
    """Positions by hash, and the hash up to which all anchors are there."""
    n, _, rest = fp.partition("|")
    held = {int(x[:8], 16): int(x[9:], 16) for x in rest.split()}
    return held, _HASHES if len(held) == int(n, 16) else max(held)


def likeness(a: str, b: str) -> float:
    """0 to 1: of the anchors that either has up to the lesser last hash, the part in both whose positions differ by the usual shift."""
    if a == b:
        return 1.0
    return _likeness(_read(a), _read(b))


def _likeness(a: tuple[dict[int, int], int], b: tuple[dict[int, int], int]) -> float:
    (x, most), (y, other) = a, b
    if not x or not y:
        return 0.0
    most = min(most, other)
    shifts = [p - y[h] for h, p in x.items() if h <= most and h in y]
    if not shifts:
        return 0.0
    union = sum(h <= most for h in x) + sum(h <= most for h in y) - len(shifts)
    usual = sorted(shifts)[len(shifts) // 2]
    slack = max(2 * K, max(max(x.values()), max(y.values())) // 50)
    return sum(abs(s - usual) <= slack for s in shifts) / union


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many of the first characters of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _pairs(names: list[str], id_type: pa.DataType, kept: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # (range, id, text, fingerprint)

        def row(now, nxt) -> tuple:
            _, i, text, fp = now
            e = edited(text, nxt[2])
            efp = fingerprint(e, kept, share)
            return i, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, nxt[3])

        for b in batches:
            out = []
            for rid, tail, i, text in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if tail and (pending is None or pending[0] != rid):
                    continue  # the range's last document has met its follower
                now = (rid, i, text or "", fingerprint(text or "", kept, share))
                if pending is not None and pending[0] == rid:
                    out.append(row(pending, now))
                pending = None if tail else now
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *map(pa.array, cols[1:])], names=names)
        assert pending is None, "a range without follower"

    return run


def _splits(rows: DataFrame, ranges: int) -> list:
    """Ids that cut the rows into about so many equal ranges, ascending."""
    kind = rows.schema["i"].dataType
    if isinstance(kind, T.IntegralType):
        shares = [x / ranges for x in range(1, ranges)] or [0.5]
        points = rows.agg(F.percentile_approx(F.col("i"), shares, 10_000).alias("p")).first()["p"] or []
    else:  # a bounded sample, by hash
        share = min(1.0, 20 * ranges / max(1, rows.count()))
        drawn = rows.where(F.col("i").isNotNull()).where(F.pmod(F.xxhash64("i", "th"), F.lit(1 << 30)) <= int(share * (1 << 30)))
        drawn = [r["i"] for r in drawn.select("i").distinct().limit(40 * ranges).orderBy("i").collect()]
        points = drawn[:: max(1, len(drawn) // ranges)]
    return sorted(set(points))


def document_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", ranges: int | None = None, kept: int = KEPT, share: float = SHARE) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    The next document is the next by ascending id (null ids last, repeated ids by a hash of the text); after
    the last comes the first. Null texts are empty; empty texts have an empty fingerprint, which is like
    itself only. Texts travel once, into ranges of ids; the first document of each range also goes to the
    range before. An empty table gives no rows; other columns are not looked at. Ids (integers or strings)
    are the table's key: rows of one id share a range, and so do null ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # several in a task, so that tasks are alike, and more for large tables; a range streams through its task
    ranges = ranges or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, docs.count() // 100_000))
    splits = _splits(rows, ranges)
    n = len(splits)
    if n:
        # how many splits an id has reached: a binary search by falling powers of two
        jumps, places = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]), F.array(*map(F.lit, splits))
        reached = F.aggregate(jumps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.element_at(places, F.least(p + s, F.lit(n))) <= F.col("i")), p + s).otherwise(p))
    else:
        reached = F.lit(0)
    range_of = F.when(F.col("i").isNull(), n + 1).otherwise(reached).cast("int")

    # at most one row for each range comes to the driver
    firsts = rows.select(range_of.alias("rid"), "i", "th").groupBy("rid").agg(F.min(F.struct("i", "th")).alias("f")).orderBy("rid").collect()
    used = [r["rid"] for r in firsts]
    kind = rows.schema["i"].dataType.simpleString()
    schema = f"i {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    heads = spark.createDataFrame([(r["f"]["i"], r["f"]["th"], used[k - 1]) for k, r in enumerate(firsts)], f"fi {kind}, fth long, previous int")
    met = rows.withColumn("rid", range_of).join(F.broadcast(heads), F.col("i").eqNullSafe(F.col("fi")) & (F.col("th") == F.col("fth")), "left")
    sent = met.select(F.explode(F.filter(F.array(F.struct(F.col("rid").alias("rid"), F.lit(0).alias("tail")), F.struct(F.col("previous").alias("rid"), F.lit(1).alias("tail"))), lambda x: x["rid"].isNotNull())).alias("x"), "i", "th", "text").select("x.rid", "x.tail", "i", "th", "text")
    dealt = sent.repartition("rid").sortWithinPartitions("rid", "tail", F.col("i").asc_nulls_last(), "th").select("rid", "tail", "i", "text")
    out = dealt.mapInArrow(_pairs([x.split()[0] for x in schema.split(", ")], to_arrow_type(rows.schema["i"].dataType), kept, share), schema)
    return out.withColumnRenamed("i", id)
