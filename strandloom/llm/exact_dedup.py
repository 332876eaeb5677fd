"""Exact dedup by a Golomb-coded fingerprint exchange with byte verification.

Senders (Spark partitions) sort their distinct 64-bit text hashes and send each owner (a range of hash
values) the gaps as a Golomb-Rice code. Owners decode, find hashes that occur at two senders or twice at
one, and return a bitmap to each sender. Senders turn the bitmap into suspects; only the texts of suspects
are shuffled, grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.plans.runtime import cut, discard, plain_columns

#: Hashes that a sender gathers before it sends, and hashes that an owner decodes at once, about.
BLOCK, OWNED = 1 << 20, 1 << 22
#: A group with more than one in so many rows is hot; so many are, at most.
HOT = 4096
#: Bits of the suspect filter: 16 for each suspect, so many at most (32 MB). More suspects only make it pass more rows.
FILTER_BITS = 1 << 28


def normalised(text: str | Column) -> Column:
    """White space runs as one space; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and packed remainders of the gaps of ascending uint64 values."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // len(values)) if len(values) else 1
    b = max(0, mean.bit_length() - 1)
    q = (gaps >> np.uint64(b)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(b, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return b, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, b: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * b).reshape(n, b).astype(np.uint64)
    low = (bits << np.arange(b, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(b)) + low, dtype=np.uint64)


_MESSAGE = "sender long, owner long, n long, b long, base long, unary binary, rest binary, twice binary"


def _send(owner_bits: int):
    shift = 64 - owner_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId() << 32
        seq, held, count = 0, [], 0

        def flush() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            owners = h >> np.uint64(shift) if owner_bits else np.zeros(len(h), np.uint64)
            cuts = np.flatnonzero(np.diff(owners)) + 1
            rows = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(h)], strict=True):
                base = int(owners[lo]) << shift if owner_bits else 0
                b, unary, rest = golomb_encode(h[lo:hi] - np.uint64(base))
                rows.append((pid | seq, int(owners[lo]), int(hi - lo), b, base - (1 << 64) if base >> 63 else base, unary, rest, np.packbits(times[lo:hi] > 1).tobytes()))
            names = [x.split()[0] for x in _MESSAGE.split(", ")]
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
                count += batch.num_rows
            if count >= BLOCK:
                yield flush()
                seq, held, count = seq + 1, [], 0
        if held:
            yield flush()

    return run


def _decode(m) -> np.ndarray:
    return golomb_decode(m.n, m.b, m.unary, m.rest) + np.uint64(m.base & (1 << 64) - 1)


def _own(messages: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: a bitmap for each message, set where the hash is at another sender or twice at its own."""
    lists = [_decode(m) for m in messages.itertuples()]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[times > 1]
    maps = []
    for m, h in zip(messages.itertuples(), lists, strict=True):
        flags = np.unpackbits(np.frombuffer(m.twice, np.uint8), count=m.n).astype(bool)
        maps.append(np.packbits(flags | np.isin(h, shared, assume_unique=True)).tobytes())
    return pd.DataFrame({"sender": messages["sender"], "owner": messages["owner"], "flags": maps})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.to_pandas().itertuples():
            hit = _decode(m)[np.unpackbits(np.frombuffer(m.flags, np.uint8), count=m.n).astype(bool)]
            yield pa.RecordBatch.from_arrays([pa.array(hit.view(np.int64))], names=["h"])


def suspect_hashes(hashes: DataFrame, n_rows: int) -> DataFrame:
    """The distinct values of the long column ``h`` that occur more than once, by the exchange."""
    owner_bits = max(0, (n_rows // OWNED).bit_length())
    sent = cut(hashes.select("h").mapInArrow(_send(owner_bits), _MESSAGE), "golomb")
    replies = sent.repartition("owner").groupBy("owner").applyInPandas(_own, "sender long, owner long, flags binary")
    return cut(sent.join(replies, ["sender", "owner"]).mapInArrow(_suspects, "h long").distinct(), "suspects")


def bit_array(values: DataFrame, most: int = FILTER_BITS) -> np.ndarray | None:
    """64-bit words of a power of two bits in which the low bits of every long ``h`` of ``values`` are set; None if there is none.

    16 bits for each value and ``most`` at most, filled by a partial aggregation of words, so that the driver
    gets as many rows as the array has words.
    """
    n = values.count()
    if not n:
        return None
    bits = min(most, 1 << max(10, (16 * n).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = values.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))")).alias("v"))
    array = np.zeros(bits >> 6, np.int64)
    got = words.toArrow()
    array[got["w"].to_numpy()] = got["v"].to_numpy()
    return array.view(np.uint64)


def held_by(array: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which uint64 values have their bit set."""
    x = h & np.uint64(64 * len(array) - 1)
    return (array[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1


def membership_filter(values: DataFrame) -> Column | None:
    """A test of a long that passes every member of ``values`` (long ``h``) and few others; None if there is no member."""
    array = bit_array(values)
    if array is None:
        return None
    held = values.sparkSession.sparkContext.broadcast(array)

    @F.pandas_udf("boolean")
    def member(h: pd.Series) -> pd.Series:
        return pd.Series(held_by(held.value, h.to_numpy(np.int64).view(np.uint64)))

    return member


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``, dropped ones too.

    Texts are equal when identical after white space runs become one space; null counts as empty. Exactly
    one row of each group is kept: the one with the smallest id (null ids last; of rows that repeat the
    id, any one). keep_id is null only where all ids of a group are. An empty table gives no rows; other
    columns are not looked at.
    """
    texts = docs.select(F.col(id).alias("id"), normalised(text).alias("text"))
    digest = cut(texts.select("id", F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "digest")
    rows = digest.count()
    suspects = suspect_hashes(digest, rows)
    member = membership_filter(suspects)
    schema = ["id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = lambda d: d.select("id", "id", F.lit(1).cast("long"), F.lit(True), "sha").toDF(*schema)
    if member is None:
        return alone(digest).withColumnsRenamed({"id": id})
    # byte verification: partial aggregation merges the copies in each partition before the shuffle
    shuffled = texts.select("text", F.xxhash64("text").alias("h")).where(member("h"))
    verified = shuffled.groupBy("h", "text").agg(F.count("*").alias("n")).where("n > 1").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "n")
    some = digest.where(member("h"))
    firsts = some.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    groups = cut(verified.join(firsts, "sha").select("sha", "n", "first.id", "first.row").toDF("sha", "n", "keep", "first_row"), "groups")
    # rows of hot groups, of which there are HOT at most, stay where they are; the others meet their group by hash
    hot = F.col("n") * HOT > rows
    near = some.join(F.broadcast(groups.where(hot)), "sha", "left")
    far = near.where("n is null").select(*some.columns).join(groups.where(~hot), "sha", "left")
    single = F.col("n").isNull()
    told = [F.col("id"), F.when(single, F.col("id")).otherwise(F.col("keep")), F.coalesce("n", F.lit(1)).cast("long"), single | (F.col("row") == F.col("first_row")), F.col("sha")]
    named = [d.select(*told).toDF(*schema) for d in (near.where("n is not null"), far)]
    return alone(digest.where(~member("h"))).union(named[0]).union(named[1]).withColumnsRenamed({"id": id})


def without(docs: DataFrame, gone: DataFrame, key: Column, same) -> DataFrame:
    """The rows of ``docs`` that ``same(docs)`` joins with no row of ``gone``, a table with the hash ``h`` of ``key``.

    Rows whose hash the filter turns down pass as they are; only the others are shuffled.
    """
    member = membership_filter(gone.select("h").distinct())
    if member is None:
        return docs
    some = docs.where(member(key))
    return docs.where(~member(key)).union(some.join(gone, same(some), "left_anti"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns: one of each group.

    Of rows that repeat both id and normalised text, or whose ids are all null, any one stays.
    """
    docs, (id, text), restored = plain_columns(docs, id, text)
    sha = lambda d: F.sha2(normalised(d[text]).cast("binary"), 256)
    lost = exact_groups(docs, id, text).where("not kept").select(F.col(id).alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"), F.col(id).eqNullSafe(F.col("keep_id")).alias("_again_")).distinct()
    lost = cut(lost.withColumn("h", F.xxhash64("_gone_id")), "gone")
    gone, twice = lost.where("not _again_"), lost.where("_again_")
    same = lambda d, g: d[id].eqNullSafe(g["_gone_id"]) & (sha(d) == g["_gone_sha"])
    key = F.xxhash64(F.col(id))
    left = without(docs, gone, key, lambda d: same(d, gone))
    member = membership_filter(twice.select("h").distinct())
    if member is None:
        return restored(left)
    some, twice = left.where(member(key)), twice.select("_gone_id", "_gone_sha")
    once = some.join(twice, same(some, twice)).dropDuplicates(["_gone_id", "_gone_sha"]).drop("_gone_id", "_gone_sha")
    return restored(left.where(~member(key)).union(some.join(twice, same(some, twice), "left_anti")).union(once))
