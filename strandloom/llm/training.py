"""Shared parts of the classifiers: splits, bounded samples, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE = 20_000


def remainder(id: str, modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, most: int = SAMPLE, of: str | None = None) -> DataFrame:
    """``most`` rows at most, by a hash of all their columns: the same in every run. Only for fitting.

    Rows that are alike in all columns are drawn alike, up to ``most``. Of each value of the column ``of``
    at least a quarter of an equal share is drawn, so that rare values are there too.
    """
    n = rows.count()
    if n <= most:
        return rows
    scale, share = 1 << 30, 1.1 * most / n
    drawn = F.lit(share)
    if of:
        times = rows.groupBy(of).count().orderBy(F.desc("count"), of).limit(most).collect()  # most values at most
        few = [(r[of], min(1.0, most / (4 * len(times) * r["count"]))) for r in times]
        few = [(v, s) for v, s in few if s > share]
        if few:
            drawn = F.greatest(drawn, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in few for x in pair]), F.col(of)), F.lit(0.0)))
    key = F.pmod(F.xxhash64(F.lit("sample"), *rows.columns), F.lit(scale))
    # rare values first: together they are a quarter at most
    picked = rows.withColumn("_draw_", key).withColumn("_share_", drawn).where(F.col("_draw_") < F.col("_share_") * scale)
    return picked.orderBy(F.col("_share_") <= share, F.col("_draw_") / F.col("_share_"), *rows.columns).limit(most).drop("_draw_", "_share_")


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: ascending score knots and their non-decreasing rates."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # rate, weight, least and largest score
    w = np.ones(len(scores)) if weights is None else weights
    for i in order:
        blocks.append([float(labels[i]), float(w[i]), float(scores[i]), float(scores[i])])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            r, n, _, hi = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + r * n) / (p[1] + n), p[1] + n, p[2], hi]
    x = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    y = [b[0] for b in blocks for _ in ((0, 1) if b[3] > b[2] else (0,))]
    return np.array(x), np.array(y)


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton's method, lightly regularised."""
    x = np.stack([scores, np.ones(len(scores))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - labels) + 1e-2 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
