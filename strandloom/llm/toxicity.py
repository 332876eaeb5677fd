"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features: densities of a fixed lexicon and of one learned from the labels, hits near second-person words,
capitals, punctuation and obfuscation rates. The learned lexicon's counts cover all rows that may be learned
from; trees and calibration are fitted on a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.exact_dedup import membership_filter
from strandloom.llm.training import bounded_sample, isotonic, remainder
from strandloom.plans.runtime import cut

#: Insults and second-person words of four languages.
LEXICON = "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb fool ugly filthy vermin garbage imbecile bastard hate kill dumm trottel abschaum versager wertlos ekelhaft widerlich idiota imbécil basura estúpido estúpida inútil asqueroso payaso crétin ordure imbécile débile minable stupide dégoûtant".split()
SECOND_PERSON = "you your yours yourself ya u du dich dir dein deine ihr euch sie tu te ti tus usted ustedes vos toi ton ta tes vous votre vos".split()
#: Words of the learned lexicon, at most.
LEARNED = 200
#: Words that may be broadcast; more are joined by a shuffle.
BROADCAST = 100_000
NEAR = 6
_WORD = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457@$!|", "oieastasil")
#: Marks and digits between letters.
_ODD = re.compile(r"[^\W\d_][0134578@$!|*.\-_]+[^\W\d_]")
_GONE = re.compile(r"[*.\-_]")


def features(text: str, learned: frozenset[str]) -> list[float]:
    """Of one whole text; empty texts have zeros."""
    tokens = _WORD.findall(text.lower())
    n, kinds = len(tokens), set(tokens)
    fixed = _FIXED & kinds
    hits = [i for i, t in enumerate(tokens) if t in fixed] if fixed else []
    more = sum(map(tokens.count, learned & kinds)) if n < 500 else sum(map(learned.__contains__, tokens))
    near = sum(not _SECOND.isdisjoint(tokens[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    odd = masked = 0
    if _ODD.search(text):
        for w in text.split():
            if not _ODD.search(w):
                continue
            odd += 1
            low = w.lower()
            plain = _WORD.findall(_GONE.sub("", low).translate(_LEET))
            masked += any(p in _FIXED or p in learned for p in plain) and not any(p in _FIXED or p in learned for p in _WORD.findall(low))
    chars = max(1, len(text))
    upper = sum(map(str.isupper, text)) if len(text) < 64 else _upper(text)
    gap = float(min(b - a for a, b in zip(hits, hits[1:], strict=False))) if len(hits) > 1 else 1e4
    marks = text.count("!") + text.count("?")
    symbols = sum(map(text.count, "#$%&*|"))
    m = max(1, n)
    return [len(hits), len(hits) / m, len(fixed), more, more / m, near, near / m, gap, upper / chars, marks / chars, symbols / chars, odd / m, masked, masked / m, math.log1p(n), len(kinds) / m]


def _upper(text: str) -> int:
    """Capitals: letters that lower-casing changes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = text.lower()
    if len(low) != len(text):
        return sum(map(str.isupper, text))
    return int((c != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")).sum())


_FIXED, _SECOND = frozenset(LEXICON), frozenset(SECOND_PERSON)
N_FEATURES = 16


def learn_lexicon(labelled: DataFrame, most: int = LEARNED) -> list[str]:
    """Words of (words, label) rows that mark label 1: in 2 % of its rows at least, and with ten times the odds.

    Words of label 1 are counted first. Those in 2 % of its rows are at most 50 times the words of a row;
    only they are counted in the other rows.
    """
    totals = labelled.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    if not totals["p"] or totals["p"] == totals["n"]:
        return []
    p, rest = totals["p"], totals["n"] - totals["p"]
    count = lambda rows: rows.select(F.explode("words").alias("w")).where("w <> ''")
    often = cut(count(labelled.where("label = 1")).groupBy("w").agg(F.count("*").alias("a")).where(F.col("a") >= max(3, 0.02 * p)), "often")
    wanted = often.select("w")
    wanted = F.broadcast(wanted) if often.count() <= BROADCAST else wanted
    others = count(labelled.where("label = 0")).join(wanted, "w").groupBy("w").agg(F.count("*").alias("b"))
    odds = ((F.col("a") + 0.5) / p) / ((F.coalesce("b", F.lit(0)) + 0.5) / rest)
    best = often.join(others, "w", "left").withColumn("odds", odds).where("odds >= 10").orderBy(F.desc("odds"), "w").limit(most)
    return [r["w"] for r in best.select("w").collect()]


class Trees:
    """Gradient boosting of the logistic loss with histogram splits on quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, reg: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.reg = rounds, depth, rate, bins, reg

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        f = np.full(n, self.base)
        flat = code + np.arange(d) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(n, np.int64), {}
            for level in range(self.depth):
                for k in range(2**level):
                    at = np.flatnonzero(node == k)
                    if len(at) < 10:
                        continue
                    size = d * self.bins
                    gs = np.bincount(flat[at].ravel(), np.repeat(g[at], d), size).reshape(d, -1).cumsum(1)
                    hs = np.bincount(flat[at].ravel(), np.repeat(h[at], d), size).reshape(d, -1).cumsum(1)
                    G, H = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.reg) + (G - gs) ** 2 / (H - hs + self.reg) - G**2 / (H + self.reg)
                    gain[(hs < 1) | (H - hs < 1)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(self.edges[j]):
                        splits[level, k] = (int(j), float(self.edges[j][b]))
                goes = np.zeros(n, np.int64)
                for k in range(2**level):
                    if (level, k) in splits:
                        j, t = splits[level, k]
                        goes = np.where((node == k) & (x[:, j] > t), 1, goes)
                node = node * 2 + goes
            leaf = np.array([self.rate * g[node == k].sum() / (h[node == k].sum() + self.reg) for k in range(2**self.depth)])
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                goes = np.zeros(len(x), np.int64)
                for k in range(2**level):
                    if (level, k) in splits:
                        j, t = splits[level, k]
                        goes = np.where((node == k) & (x[:, j] > t), 1, goes)
                node = node * 2 + goes
            f += leaf[node]
        return f


def _fit(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Trees on all rows; isotonic calibration on scores that five-fold models give rows they did not see."""
    if not len(y) or y.min() == y.max():
        return None
    fold = np.random.default_rng(3).permutation(len(y)) % 5
    out = np.zeros(len(y))
    for k in range(5):
        a, b = fold != k, fold == k
        out[b] = Trees().fit(x[a], y[a]).score(x[b]) if 0 < y[a].sum() < a.sum() else 0.0
    knots = isotonic(out, y)
    return {"trees": Trees().fit(x, y), "x": knots[0], "y": knots[1]}


def calibrated(model: dict, f: np.ndarray) -> np.ndarray:
    """Isotonic rates with a slight slope inside flat parts, so that the order of raw scores is kept."""
    p = np.interp(f, model["x"], model["y"])
    return np.clip(p * 0.998 + 0.002 / (1 + np.exp(-f)), 0, 1)


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Learned only from rows whose crc32 of the id as text, mod 3, is not 1 (null ids count as empty text).
    Null texts count as empty and are scored like any text. Null labels are not learned from; if no two
    classes are left, every score is the base rate, or 0 without labels. Repeated rows are scored alike; an
    empty table gives no rows; further columns are not looked at.
    """
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("long").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    # a filter of bounded size lets few unlabelled texts into the shuffle
    member = membership_filter(marks.where(remainder("id", 3) != 1).select(F.xxhash64("id").alias("h")))
    lexicon = []
    if member is not None:
        some = own.where(remainder("id", 3) != 1).where(member(F.xxhash64("id")))
        # distinct words travel as one string, which takes far less room than an array
        terms = some.select("id", F.array_join(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), " ").alias("words"))
        lexicon = learn_lexicon(cut(terms.join(marks, "id").select("words", (F.col("label") == 1).cast("int").alias("label")), "terms").withColumn("words", F.split("words", " ")))
    known = frozenset(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    kind = own.schema["id"].dataType
    dense = cut(own.mapInArrow(run, own.select("id").schema.add("x", T.ArrayType(T.DoubleType()))), "toxic")
    assert dense.schema["id"].dataType == kind
    sample = bounded_sample(dense.where(remainder("id", 3) != 1).join(marks, "id")).toPandas().sort_values(["id", "label"], kind="stable")
    x = np.array(sample["x"].tolist(), float).reshape(-1, N_FEATURES)
    y = sample["label"].to_numpy(float)
    model = _fit(x, y)
    base = float(y.mean()) if len(y) else 0.0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array(b.column(1).to_pylist(), float).reshape(-1, N_FEATURES)
            s = calibrated(model, model["trees"].score(m)) if model else np.full(len(m), base)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["id", "score"])

    scored = dense.mapInArrow(judge, own.select("id").schema.add("score", "double"))
    return scored.select(F.col("id").alias(id), (remainder("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
