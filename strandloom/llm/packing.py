"""Best-fit packing of tokenised documents by hierarchical residual packing.

Partitions tokenise and best-fit locally; bins that are nearly full are final. Underfull bins are merged in
a tree: every round brings the bins of several tasks together as items for another best-fit, until one
group is left or a round no longer lowers the number of bins. Tokens never leave the task that made them;
only (document, piece, length) rows travel.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.plans.runtime import cut

#: Items that one task packs at once; more are packed in several lots.
LOT = 200_000
#: Distinct words met lately whose ids a worker remembers, and as many of those before them.
REMEMBERED = 150_000
#: Bytes of text whose words are looked up in one call, about.
GROUP = 1 << 20
_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary's splitting never joins characters across white space, nor what normalises to a final letter
    or digit with the marks behind it, and is blind to case; so a text's ids are those of its words and marks in order.
    The words of many texts are told apart at once, as columns; ids of a word are looked up, and put together by numpy.
    Of the words not met lately, those of letters are split by the vocabulary's model; the others are encoded in one
    call, with a separator between them whose id nothing else has.
    """

    MARKS = b"!#$%&*,.:;?|"
    ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.met: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies write these bytes as themselves
        rest = (b for b in range(256) if b not in plain)
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.separator = self._ids("\x00")
        assert len(self.separator) == 1

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, new: list[bytes]) -> list[bytes]:
        split, pack = self.model.tokenize, struct.pack
        out, plain = [b""] * len(new), []
        for i, w in enumerate(new):
            s = w.decode()
            if s.isalpha() and (s.isascii() or self._latin(s)):
                # letters of one case and form: normalising and splitting leave them whole
                s = s.lower()
                ids = [t.id for t in split(s if s.isascii() else s.encode().decode("latin-1").translate(self.letters))]
                out[i] = pack(f"<{len(ids)}I", *ids)
            elif "\x00" in s or "<|" in s:
                ids = self._ids(s)
                out[i] = pack(f"<{len(ids)}I", *ids)
            elif s:
                plain.append((i, s))
        if plain:
            ids = np.array(self._ids(" \x00 ".join([s for _, s in plain])), "<u4")
            ends = np.append(np.flatnonzero(ids == self.separator[0]), len(ids))
            assert len(ends) == len(plain)
            data, at = ids.tobytes(), 0
            for (i, _), end in zip(plain, (ends * 4).tolist(), strict=True):
                out[i] = data[at:end]
                at = end + 4
        return out

    @staticmethod
    def _latin(s: str) -> bool:
        """Composed Latin letters, which have one lower case each."""
        low = s.lower()
        return max(s) < "\u0250" and len(low) == len(s) and low.isalpha() and max(low) < "\u0250"

    @staticmethod
    def _whole(core: bytes) -> bool:
        """Whether a letter or digit is last once normalised: some letters end in a mark then, which joins those behind it."""
        if core[-1] < 128:
            return core[-1:].isalnum()
        last = unicodedata.normalize("NFC", core.decode()).lower()[-1:]
        return unicodedata.category(last)[0] in "LN"

    def _look(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. Words met lately are kept, those before them until as many others have been met."""
        met, earlier = self.met, self.earlier
        out = list(map(met.get, words))
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                if (ids := earlier.get(w)) is None:
                    new.append(i)
                else:
                    out[i] = met[w] = ids
        for i, ids in zip(new, self._encode([words[i] for i in new]), strict=True):
            out[i] = met[words[i]] = ids
        if len(met) > REMEMBERED:
            self.met, self.earlier = {}, met
        return out

    def _parts(self, tokens: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, pa.LargeStringArray]:
        """Of each token its word, whether marks were taken off that, and these marks."""
        core = pc.ascii_rtrim(tokens, characters=self.MARKS.decode())
        ends = np.frombuffer(core.buffers()[1], np.int64)[: len(core) + 1]
        length = np.diff(ends)
        cut = (length > 0) & (length < pc.binary_length(tokens).to_numpy()) & ~pc.match_substring(tokens, "<|").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cut)
        if not len(at):
            return tokens, cut, tokens.slice(0, 0)
        last = np.frombuffer(core.buffers()[2], np.uint8)[ends[at + 1] - 1]
        cut[at] = self.ALNUM[last]
        odd = at[last > 127]
        cut[odd] = [self._whole(c) for c in core.take(pa.array(odd)).cast(pa.large_binary()).to_pylist()]
        whole = tokens.filter(pa.array(cut)).cast(pa.large_binary()).to_pylist()
        marks = [t[n:] for t, n in zip(whole, length[cut].tolist(), strict=True)]
        return pc.if_else(pa.array(cut), core, tokens), cut, pa.array(marks, pa.large_string())

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not texts:
            return []
        texts = [t if b"<|" in t else t.lower() for t in texts]
        ends = np.cumsum([0, *map(len, texts)])
        lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(b"".join(texts))))
        coded = lists.values.dictionary_encode()
        words, cut, marks = self._parts(coded.dictionary)
        pool = pa.chunked_array([words, marks]).combine_chunks().dictionary_encode()
        found = self._look(pool.dictionary.cast(pa.large_binary()).to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        # of each distinct token the ids of its word, then of its marks
        code = pool.indices.to_numpy()
        runs = np.zeros((len(cut), 2, 2), np.int64)
        runs[:, 0] = np.stack([first, size], 1)[code[: len(cut)]]
        runs[cut, 1] = np.stack([first, size], 1)[code[len(cut) :]]
        ids = _gather(np.frombuffer(b"".join(found), "<u4"), runs[:, :, 0].ravel(), runs[:, :, 1].ravel())
        size = runs[:, :, 1].sum(1)
        each = coded.indices.to_numpy()
        n = size[each]
        ids = _gather(ids, (np.cumsum(size) - size)[each], n)
        at = np.append(0, np.cumsum(n))[lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def __call__(self, data: bytes) -> np.ndarray:
        return np.frombuffer(self.many([data])[0], "<u4")


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, with what it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rooms: list[int] = []  # distinct free spaces, ascending
    at: dict[int, list[int]] = {}  # free space -> bins
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room]
                del rooms[k]
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room := room - n:
            if room not in at:
                at[room] = []
                bisect.insort(rooms, room)
            at[room].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _local(path: str, capacity: int, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pid, used, end = _tokenizer(path), TaskContext.get().partitionId() << 32, 0, np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal used
            lengths = np.array([r[3] for r in rows], np.int64)
            bins, offsets, fill = best_fit(lengths, capacity)
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(pid + used + bins), pa.array(offsets), pa.array(fill[bins])],
                names=[x.split()[0] for x in _SCHEMA.split(", ")],
            )
            used += len(fill)
            rows.clear()
            return out

        def take(docs: list, texts: list[bytes]) -> None:
            for doc, data in zip(docs, tokenizer.many(texts), strict=True):
                data += end
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))

        for batch in batches:
            docs, texts, size = [], [], 0
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                texts.append(data or b"")
                size += len(texts[-1])
                if size >= GROUP:
                    take(docs, texts)
                    docs, texts, size = [], [], 0
            take(docs, texts)
            if len(rows) >= LOT:
                yield flush()
        if rows:
            yield flush()

    return run


def _merge(capacity: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole bins; a bin is an item of the length of its fill."""
        pid, used = (level << 56) | (TaskContext.get().partitionId() << 32), 0
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(rows: pa.Table) -> pa.Table:
            nonlocal used
            seq, fill = rows["sequence_id"].to_numpy(), rows["fill"].to_numpy()
            _, first, back = np.unique(seq, return_index=True, return_inverse=True)
            bins, offsets, full = best_fit(fill[first], capacity)
            out = rows.set_column(5, "sequence_id", pa.array(pid + used + bins[back])).set_column(6, "offset", pa.array(rows["offset"].to_numpy() + offsets[back])).set_column(7, "fill", pa.array(full[bins[back]]))
            used += len(full)
            return out

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count > LOT:  # whole bins only: rows come sorted by sequence
                t = pa.Table.from_batches(held)
                seq = t["sequence_id"].to_numpy()
                keep = int(np.searchsorted(seq, seq[-1]))
                if keep:
                    yield from flush(t.slice(0, keep)).to_batches()
                    held = t.slice(keep).to_batches()
                    count = t.num_rows - keep
        if count:
            yield from flush(pa.Table.from_batches(held)).to_batches()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, nearly: float = 0.999, fan_in: int = 8) -> DataFrame:
    """One row for each piece: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its token ids and ``end_id``; null and empty texts are the end alone. Only documents over
    ``capacity`` are cut, into full pieces and a rest. Offsets are gapless from 0 in each sequence. Ids are
    carried through, null or repeated: every row of ``docs`` is packed. An empty table gives no rows; other
    columns are not looked at. Every worker reads the vocabulary at ``tokenizer_path``.
    """
    kind = docs.select(F.col(id).alias("i")).schema["i"].dataType
    schema, arrow = _SCHEMA.format(id=kind.simpleString()), to_arrow_type(kind)
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("data"))
    enough = int(capacity * nearly)
    now = cut(texts.mapInArrow(_local(tokenizer_path, capacity, end_id, arrow), schema), "pack0")
    done, level = [], 0
    tasks = max(1, now.select(F.shiftright("sequence_id", 32).alias("p")).distinct().count())
    last = None  # (tasks, bins) of the level before
    while True:
        done.append(now.where(F.col("fill") >= enough))
        rest = now.where(F.col("fill") < enough)
        rows, bins = rest.agg(F.count("*"), F.sum((F.col("offset") == 0).cast("long"))).first()
        if not rows or bins <= 1 or (last and (last[0] == 1 or last == (max(-(-tasks // fan_in), -(-rows // LOT)), bins))):
            done.append(rest)
            break
        tasks = max(-(-tasks // fan_in), -(-rows // LOT))
        last, level = (tasks, bins), level + 1
        # the bins of some tasks meet in one: the tree's next level
        now = cut(rest.repartition(tasks, F.shiftright("sequence_id", 32) % tasks).sortWithinPartitions("sequence_id").mapInArrow(_merge(capacity, level), schema), f"pack{level}")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(F.col("doc_id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
