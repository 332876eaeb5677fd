"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of its own and of the neighbouring lines. Marginals of
good, by forward-backward over the whole document, are averaged by line length and calibrated. Labels are of
documents: lines start with their document's, lines of bad documents that look clearly good are then
relabelled, and the field is fitted to that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.training import bounded_sample, platt, remainder

#: Labelled documents that the field and its calibration are fitted on, at most.
SAMPLE = 4000
OWN = 11
WIDTH = 1 + 3 * OWN + 2
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~=+_<>\\/{}[]"]] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-empty lines, their lengths, and the number of lines of each text."""
    lines, count = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = [x for x in t.split("\n") if x]
        count[i] = len(own)
        lines += own
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0), count
    size = np.array([len(x) for x in lines], np.int64)
    whole = "".join(lines)
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    low = whole.lower()
    low = low if len(low) == len(whole) else "".join(x.lower() if len(x.lower()) == 1 else x for x in whole)
    at = np.r_[0, np.cumsum(size)[:-1]]
    share = lambda flags: np.add.reduceat(flags, at, dtype=np.int64) / size
    plain = c < 128
    code = np.where(plain, c, 0).astype(np.int64)
    upper = c != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (~plain) | ((code | 32) >= 97) & ((code | 32) <= 122)
    words = np.zeros((len(lines), 4))
    for i, x in enumerate(lines):
        w = x.split()
        n = len(w)
        if n:
            same = sum(map(str.__eq__, w, w[1:])) if n > 1 else 0
            words[i] = (len(set(w)) / n, same / n, n, x[-1] in ".!?")
    f = np.zeros((len(lines), OWN))
    f[:, 0] = np.log1p(size) / 5
    f[:, 1] = share(upper)
    f[:, 2] = share((code >= 48) & (code <= 57))
    f[:, 3] = share(_SYMBOLS[np.minimum(code, 127)] & plain)
    f[:, 4] = share(c == 124)
    f[:, 5] = share(c == 33)
    f[:, 6] = share(letter)
    f[:, 7] = words[:, 0]
    f[:, 8] = words[:, 1]
    f[:, 9] = np.minimum(size / np.maximum(words[:, 2], 1), 30) / 10
    f[:, 10] = words[:, 3]
    f[:, [2, 3, 4, 5]] = np.sqrt(f[:, [2, 3, 4, 5]])
    first = np.zeros(len(lines), bool)
    starts = np.cumsum(count) - count
    first[starts[count > 0]] = True
    last = np.r_[first[1:], True]
    before, after = np.roll(f, 1, 0), np.roll(f, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(lines), 1)), f, before, after, first[:, None], last[:, None]], 1), size.astype(float), count


def _sum_exp(a: np.ndarray) -> np.ndarray:
    m = a.max(-1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(-1, keepdims=True)))[..., 0]


def marginals(emit: np.ndarray, trans: np.ndarray, count: np.ndarray, pairs: bool = False):
    """P(good) of each line, by forward-backward over all documents at once; with ``pairs`` also expected transitions.

    emit: score of good (bad has 0) of each line; trans: 2 x 2 scores; count: lines of each document.
    """
    n = len(emit)
    starts = (np.cumsum(count) - count)[count > 0]
    sizes = count[count > 0]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    e = np.stack([np.zeros(n), emit], 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")  # documents with a line t
    for t, k in enumerate(live):
        at = starts[:k] + t
        alpha[at] = e[at] if t == 0 else e[at] + _sum_exp(alpha[at - 1][:, None, :] + trans.T[None])
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        beta[at] = _sum_exp(trans[None] + (e[at + 1] + beta[at + 1])[:, None, :])
    joint = alpha + beta
    z = _sum_exp(joint) if n else np.zeros(0)
    good = np.exp(joint[:, 1] - z)
    if not pairs:
        return good
    inner = np.ones(n, bool)
    inner[starts + sizes - 1] = False
    at = np.flatnonzero(inner)
    p = alpha[at][:, :, None] + trans[None] + (e[at + 1] + beta[at + 1])[:, None, :] - z[at][:, None, None]
    return good, np.exp(p).sum(0), at


def fit_field(x: np.ndarray, y: np.ndarray, count: np.ndarray, steps: int = 120, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions of greatest conditional likelihood (Adam on the exact gradient)."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = v = np.zeros(x.shape[1] + 4)
    n = max(1, len(x))
    for step in range(1, steps + 1):
        good, expected, at = marginals(x @ w, trans, count, pairs=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at], y[at + 1]), 1)
        g = np.concatenate([x.T @ (y - good) / n - l2 * w, (seen - expected).ravel() / n - l2 * trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[: x.shape[1]], trans + move[x.shape[1] :].reshape(2, 2)
    return w, trans


def raw_quality(good: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals as log-odds; 0 for documents without a line."""
    doc = np.repeat(np.arange(len(count)), count)
    total = np.bincount(doc, size, len(count))
    mean = np.bincount(doc, size * good, len(count)) / np.maximum(total, 1)
    mean = np.clip(mean, 1e-3, 1 - 1e-3)
    return np.where(count > 0, np.log(mean / (1 - mean)), 0.0)


def fit(texts: list[str], labels: np.ndarray) -> dict | None:
    if not len(labels) or labels.min() == labels.max():
        return None
    x, size, count = line_features(texts)
    doc = np.repeat(np.arange(len(count)), count)
    y = labels.astype(np.int64)[doc]
    alone = np.ones(len(y), np.int64)
    w, _ = fit_field(x, y, alone)  # lines without their chains
    p = 1 / (1 + np.exp(-(x @ w)))
    worst = np.zeros(len(y), bool)
    order = np.lexsort((p, doc))
    worst[order[np.r_[True, doc[order][1:] != doc[order][:-1]]] if len(order) else []] = True
    y = np.where((y == 0) & (p > 0.9) & ~worst, 1, y)
    w, trans = fit_field(x, y, count)
    raw = raw_quality(marginals(x @ w, trans, count), size, count)
    return {"w": w, "trans": trans, "platt": platt(raw, labels)}


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Learned only from rows whose crc32 of the id as text, mod 5, is not 0 (null ids count as empty text).
    Null texts count as empty; a text without a line has even odds before calibration. Null labels are not
    learned from; if no two classes are left, every score is the base rate, or 0 without labels. Repeated
    rows are scored alike; an empty table gives no rows; further columns are not looked at.
    """
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(marks.where(remainder("id", 5) != 0), SAMPLE)  # labels first: only their texts move
    # an id may repeat: SAMPLE rows at most come to the driver, and the join's broadcast has SAMPLE rows too
    sample = bounded_sample(own.join(F.broadcast(chosen), "id"), SAMPLE).toPandas().sort_values(["id", "text"])
    model = fit(sample["text"].tolist(), sample["label"].to_numpy(float))
    base = float(sample["label"].mean()) if len(sample) else 0.0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                if model is None:
                    s = np.full(part.num_rows, base)
                else:
                    x, size, count = line_features(part.column(1).to_pylist())
                    raw = raw_quality(marginals(x @ model["w"], model["trans"], count), size, count)
                    s = 1 / (1 + np.exp(-np.clip(model["platt"][0] * raw + model["platt"][1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["id", "score"])

    scored = own.mapInArrow(judge, own.select("id").schema.add("score", "double"))
    return scored.select(F.col("id").alias(id), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
