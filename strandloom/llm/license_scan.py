"""Licence scans: a trained paragraph classifier confirmed by template comparison, in SQL functions only.

Paragraphs are lines and, as notices are wrapped and commented in many ways, what neighbouring lines make
together.

A sparse multinomial logistic regression over word n-grams (1 to 3) tells licence families and an unknown
class. It is fitted on the driver from the notices below and a bounded sample of corpus paragraphs; scoring
is a broadcast join of n-grams with weights. A prediction counts if its calibrated probability passes and
the paragraph contains enough of one of the family's templates.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.plans.runtime import cut

# Usual short notices of public licences.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "Apache-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"],
    "BSD-3-Clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "use of this source code is governed by a bsd style license"],
    "CC-BY-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0-1.0": ["to the extent possible under law the author has waived all copyright and related rights to this work", "dedicated to the public domain under cc0 1 0"],
    "GPL-2.0": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu gpl version 2"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public license as published by the free software foundation", "licensed under the gnu gpl version 3"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license"],
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "licensed under the mit license"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
}
UNKNOWN = "unknown"
#: Corpus paragraphs that the unknown class is fitted on, at most.
SAMPLE = 3000
_SPLIT, _LINE = r"[^a-z0-9]+", r"\r\n?|\n"
#: Line numbers in the lower half of a long.
_PAIR = 1 << 31


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _grams(words: list[str], most: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def _shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} or set(words)


def gate_words(rate: dict[str, float], confirm: float) -> list[str]:
    """Rare words of which every text has one that holds the share ``confirm`` of some template's word pairs.

    Of each template the rarest words are taken, until fewer pairs than that are left without one.
    """
    found: set[str] = set()
    for t in sorted(x for ts in TEMPLATES.values() for x in ts):
        pairs = _shingles(_words(t))
        touched = lambda w: sum(w in p.split() for p in pairs)
        words = sorted(set(_words(t)), key=lambda w: (rate.get(w, 0), w not in found, -touched(w), w))
        left, taken = set(pairs), set()
        while len(left) >= confirm * len(pairs) and words:
            w = words.pop(0)
            taken.add(w)
            left = {p for p in left if w not in p.split()}
        found |= taken
    return sorted(found)


def fit(unknown: list[str], confirm: float = 0.6, seed: int = 11, copies: int = 25, steps: int = 400, l1: float = 2e-4) -> dict:
    """Weights of n-grams for each class, temperature, and the words without one of which no template is met."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    classes = [*families, UNKNOWN]
    plain = [_words(t) for t in unknown]
    known = [_shingles(_words(t)) for ts in TEMPLATES.values() for t in ts]
    # neither notices nor lines of wrapped ones
    plain = [w for w in plain if w and not any(2 * len(s & x) >= min(len(s), len(x)) for x in [_shingles(w)] for s in known)]
    filler = [w for p in plain[:500] for w in p] or ["text"]
    rows, y = [], []
    for k, f in enumerate(families):
        for t in TEMPLATES[f]:
            w = _words(t)
            for c in range(copies):  # whole, with words around, with words lost
                keep = [x for x in w if c % 3 < 2 or rng.random() > 0.1]
                pad = lambda: list(rng.choice(filler, rng.integers(0, 12)))
                rows.append(_grams([*pad(), *keep, *pad()] if c else keep))
                y.append(k)
    # near misses: single words of notices in running text
    loose = sorted({x for ts in TEMPLATES.values() for t in ts for x in _words(t)})
    for _ in range(600):
        rows.append(_grams([str(x) for x in rng.permutation([*rng.choice(filler, 12), *rng.choice(loose, rng.integers(1, 4))])]))
        y.append(len(families))
    rows += [_grams(w) for w in plain]
    y += [len(families)] * len(plain)
    rate: dict[str, float] = {}
    for w in plain:
        for x in set(w):
            rate[x] = rate.get(x, 0) + 1 / len(plain)
    vocabulary = sorted(g for g in set().union(*(_grams(_words(t)) for ts in TEMPLATES.values() for t in ts)) if " " in g or rate.get(g, 0) < 0.01)
    vocabulary = [g for g in vocabulary if min(rate.get(x, 0) for x in g.split()) < 0.01]
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[g] for g in r if g in place]] = 1
    y = np.array(y)
    held = rng.random(len(y)) < 0.2
    one = np.eye(len(classes), dtype=np.float32)[y]
    weight = np.where(y == len(families), 1.0, 1.0).astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    a, bb, rate_ = x[~held], one[~held], 4.0
    for _ in range(steps):  # proximal gradient
        s = a @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - bb) * weight[~held] / len(a)
        w -= rate_ * (a.T @ g)
        b -= rate_ * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate_ * l1, 0)
    s = x[held] @ w + b
    best = min((float(t) for t in np.geomspace(0.2, 5, 60)), key=lambda t: -np.log(np.maximum((np.exp((s - s.max(1, keepdims=True)) / t) / np.exp((s - s.max(1, keepdims=True)) / t).sum(1, keepdims=True))[np.arange(len(s)), y[held]], 1e-9)).mean() if len(s) else t)
    used = [i for i in range(len(vocabulary)) if np.any(w[i])]
    return {"classes": classes, "grams": [vocabulary[i] for i in used], "w": w[used].astype(float), "b": b.astype(float), "t": best, "gate": gate_words(rate, confirm)}


def _lines(text: str):
    """Words of each line."""
    return F.transform(F.split(F.lower(text), _LINE), lambda p: F.filter(F.split(p, _SPLIT), lambda w: w != ""))


def _windows(reach: int) -> str:
    """SQL of the paragraphs among ``lines`` that hold a word of ``gate``: structs (s, e, words) of first and last line.

    A paragraph is a line, or neighbouring lines with no blank one among them, as many as a notice of ``reach``
    words may be wrapped over: those between the first and the last hold fewer words than that.
    """
    far = "aggregate(sequence(0, least({most}, {r})), struct(0 as k, 0 as w, true as o), (a, j) -> case when j = 0 then a when a.o and a.w < {r} and size(lines[{at}]) > 0 then struct(j as k, a.w + size(lines[{at}]) as w, true as o) else struct(a.k as k, a.w as w, false as o) end, a -> a.k)"
    up, down = far.format(most="g", r=reach, at="g - j"), far.format(most="size(lines) - 1 - g", r=reach, at="g + j")
    around = f"flatten(transform(sequence(0, {up}), a -> transform(sequence(0, {down}), b -> (g - a) * {_PAIR}L + g + b)))"
    hits = "filter(sequence(0, size(lines) - 1), i -> arrays_overlap(lines[i], gate))"
    pairs = f"transform(array_distinct(flatten(transform({hits}, g -> {around}))), c -> struct(cast(c div {_PAIR}L as int) as s, cast(c % {_PAIR}L as int) as e))"
    inner = "aggregate(slice(lines, x.s + 2, x.e - x.s - 1), 0, (n, l) -> n + size(l))"
    return f"transform(filter({pairs}, x -> x.e - x.s < 2 or {inner} < {reach}), x -> struct(x.s as s, x.e as e, flatten(slice(lines, x.s + 1, x.e - x.s + 1)) as words))"


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """One row for every row of ``docs``: ``(id, licenses, n_paragraphs, score, similarity, paragraph)``.

    licenses: families found, ascending and comma-separated, null for none; n_paragraphs: paragraphs that
    name one; score, similarity, paragraph: of the surest one (of equals the first), its calibrated
    probability, share of its template and number of its first line from 0; null for none.

    Paragraphs are lines and what neighbouring lines make together (see ``_windows``), so that wrapped and
    commented notices are read whole. Of the paragraphs that name a family those count that hold no smaller
    one of it; a line in paragraphs of several families belongs to the one with the largest share of its
    template; paragraphs of one family that overlap are one.

    Null and empty texts have none; repeated rows are judged alike and ids may be null; an empty table gives
    no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    share = min(1.0, SAMPLE / max(1, own.count()))  # of the documents, so that few paragraphs travel
    drawn = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) <= int(share * (1 << 30))).select(F.explode(F.split("text", _LINE)).alias("p")).where("p <> ''")
    sample = [r["p"] for r in drawn.select("p", F.xxhash64("p").alias("k")).distinct().orderBy("k", "p").limit(SAMPLE).collect()]
    model = fit(sample, confirm)
    n, reach = len(model["classes"]), max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)
    # both tables are as large as the notices above, whatever the data
    weights = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in zip(model["grams"], model["w"], strict=True)], "gram string, w array<double>")
    templates = spark.createDataFrame([(f, sorted(_shingles(_words(t)))) for f, ts in TEMPLATES.items() for t in ts], "family string, parts array<string>")
    templates = templates.groupBy("family").agg(F.collect_list("parts").alias("templates"))

    # one pass over each text tells whether a template may be met; only then it is cut into lines
    named = F.coalesce(F.lower("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(model['gate'])})(?![a-z0-9])"), F.lit(False))
    base = own.select("id", F.monotonically_increasing_id().alias("row"), F.when(named, _lines("text")).alias("lines"), F.array(*map(F.lit, model["gate"])).alias("gate"))
    opened = base.select("id", "row", F.posexplode_outer(F.expr(f"if(lines is null, null, {_windows(reach)})")).alias("place", "x"))
    met = cut(opened.select("id", "row", "place", "x.s", "x.e", "x.words"), "paragraphs")  # rows without paragraphs keep a null one

    def runs(k: int):
        return F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.array_join(F.slice("words", i, k), " "))).otherwise(F.array().cast("array<string>"))

    spread = met.where("s is not null").select("row", "s", "e", F.array_distinct(runs(2)).alias("pairs"), F.explode(F.array_distinct(F.concat(F.col("words"), runs(2), runs(3)))).alias("gram"))
    weighed = spread.join(F.broadcast(weights), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)]
    scored = weighed.groupBy("row", "s", "e").agg(F.first("pairs").alias("pairs"), *sums)
    scaled = F.array(*((F.col(f"s{k}") + F.lit(float(model["b"][k]))) / F.lit(model["t"]) for k in range(n)))
    top = scored.withColumn("z", scaled).withColumn("m", F.array_max("z"))
    top = top.withColumn("best", (F.array_position("z", F.col("m")) - 1).cast("int")).withColumn("p", F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m"))))
    sorted_out = top.withColumn("family", F.array(*map(F.lit, model["classes"]))[F.col("best")]).where((F.col("family") != UNKNOWN) & (F.col("p") >= least))
    likeness = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.size(t)))
    hits = sorted_out.join(F.broadcast(templates), "family").select("row", "family", "s", "e", "p", likeness.alias("likeness")).where(F.col("likeness") >= confirm)
    return _named(met.where("coalesce(place, 0) = 0").select("id", "row"), hits).select(F.col("id").alias(id), "licenses", "n_paragraphs", "score", "similarity", "paragraph")


def _named(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """What the paragraphs ``hits`` (row, family, s, e, p, likeness) say of each of ``rows`` (id, row)."""
    inside = W.partitionBy("row", "family").orderBy("e", F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    least = hits.withColumn("_s", F.max("s").over(inside)).where("_s is null or s > _s")
    lines = least.select("row", F.explode(F.sequence("s", "e")).alias("line"), F.struct("likeness", "p", (F.col("s") - F.col("e")).alias("short"), (-F.col("s")).alias("first"), "family", "e").alias("k"))
    own = lines.groupBy("row", "line").agg(F.max("k").alias("k")).select("row", (-F.col("k.first")).alias("s"), "k.e", "k.family", "k.p", "k.likeness").distinct()
    before = W.partitionBy("row", "family").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    fresh = own.withColumn("_e", F.max("e").over(before)).withColumn("fresh", F.when(F.col("_e").isNull() | (F.col("s") > F.col("_e")), 1).otherwise(0))
    found = fresh.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"),
        F.sum("fresh").cast("long").alias("n"),
        F.max(F.struct("p", (-F.col("s")).alias("back"), "likeness")).alias("top"),
    )
    return rows.join(found, "row", "left").select("id", "licenses", F.coalesce("n", F.lit(0).cast("long")).alias("n_paragraphs"), F.col("top.p").alias("score"), F.col("top.likeness").alias("similarity"), (-F.col("top.back")).alias("paragraph"))
