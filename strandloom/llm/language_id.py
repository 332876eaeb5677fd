"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal, per-coordinate rates, elastic net), then its
temperature is calibrated on rows that training did not see. N-grams of 1 to 3 characters of the lower-cased
text are hashed into ``DIM`` columns. Document frequencies cover all rows that may be learned from; only the
weights are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.training import bounded_sample, remainder
from strandloom.plans.runtime import plain_columns

DIM = 1 << 15
#: Rows that the weights and the temperature are fitted on, at most.
SAMPLE = 4000
UNKNOWN = "und"
_HAS_LETTER = r"\p{L}"


def grams(text: str) -> np.ndarray:
    """Hashed columns of all character n-grams, repeats included."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    out = [c * np.uint32(0x9E3779B1)]
    if len(c) > 1:
        out.append((c[:-1] * np.uint32(0x85EBCA6B)) ^ (c[1:] * np.uint32(0xC2B2AE35)))
    if len(c) > 2:
        out.append((out[1][:-1] * np.uint32(0x27D4EB2F)) ^ (c[2:] * np.uint32(0x165667B1)))
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) >> np.uint32(3)) & np.uint32(DIM - 1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and how often each occurs."""
    g = grams(text)
    if len(g) < 2000:
        return np.unique(g, return_counts=True)
    n = np.bincount(g, minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    v = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(v @ v)
    return at, v / norm if norm else v


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Of all rows; a task sends each column once, and the driver gets at most ``DIM`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[counts(t or "")[0]] += 1
                n += 1
        df[DIM] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "df"])

    sums = docs.select(text).mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(DIM + 1, np.int64)
    df[sums["at"].to_numpy()] = sums["df"].to_numpy()
    return df[:DIM], int(df[DIM])


class Ftrl:
    """Multinomial FTRL-proximal: per-coordinate rates, L1 and L2."""

    def __init__(self, dim: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = v @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = v[:, None] * p
        g2 = g * g
        sigma = (np.sqrt(self.n[at] + g2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g2


def softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(u: float) -> float:
        return -float(np.log(np.maximum(softmax(scores / np.exp(u))[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, id: str, text: str, lang: str, most: int = SAMPLE, epochs: int = 3) -> dict | None:
    """A model from all rows of ``docs`` that have a language; None without any."""
    known = docs.where(F.col(lang).isNotNull())
    sample = bounded_sample(known.where(F.col(text).rlike(_HAS_LETTER)).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), most, of="lang").toPandas()
    if not len(sample):
        return None
    df, n = document_frequencies(known, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = sample.sort_values(["id", "text"], ignore_index=True)
    langs = sorted(set(sample["lang"]))
    y = sample["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy()
    rows = [vector(t, idf) for t in sample["text"]]
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 20 else order
    learn = order[len(held) :] if len(rows) >= 20 else order
    model = Ftrl(DIM, len(langs))
    for _ in range(epochs):
        for i in rng.permutation(learn):
            model.learn(*rows[i], int(y[i]))
    w = model.weights()
    scores = np.array([rows[i][1] @ w[rows[i][0]] for i in held])
    return {"langs": langs, "idf": idf, "w": w, "t": temperature(scores, y[held])}


def identify(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``, the calibrated probability.

    Texts that are null or have no letter, and any text without a model, are ``und`` with score 0. Equal
    probabilities give the language first by code point.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIM rows, whatever the data
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m = regex.compile(_HAS_LETTER), held.value
        for b in batches:
            found, scores = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                if m is None or not t or not letter.search(t):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, v = vector(t, m["idf"])
                p = softmax(v @ m["w"][at] / m["t"])
                k = int(p.argmax())
                found.append(m["langs"][k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text_")).mapInArrow(run, schema)


def language_id(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row, learned only from rows that are not held out.

    held_out: crc32 of the id as text, mod 3, is 1 (null ids count as empty text). Rows without a language
    are judged but not learned from; repeated rows are judged alike; an empty table gives no rows; further
    columns are not looked at.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(own.where(remainder("id", 3) != 1), "id", "text", "lang")
    return identify(own, model, ["id"]).select(F.col("id").alias(id), (remainder("id", 3) == 1).alias("held_out"), "lang_pred", "score")


def language_filter(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is identified with probability ``least`` or more, unchanged.

    Rejected: null texts, texts without a letter, and texts between languages.
    """
    plain, (id, text, lang), restored = plain_columns(docs, id, text, lang)
    model = fit(plain.where(remainder(id, 3) != 1), id, text, lang)
    return restored(identify(plain, model, plain.columns, text).where(F.col("lang_pred") != UNKNOWN).where(F.col("score") >= least))
