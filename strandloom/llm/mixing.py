"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time 0..1. Its integral is the source's cumulative word
demand, scaled to the source's target. Documents of a source lie end to end in a hashed order, epoch after
epoch; inverting the demand at a document's place gives its training position. Sorting by position gives
the mix in training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.plans.runtime import plain_columns

WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of a source's weight at points of training time, for each weight: light sources fade, heavy ones grow.
SCHEDULES = {1: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def invert_demand(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which the integral of the piecewise linear schedule has reached this share of the whole."""
    parts = [(a[0], a[1], b[1], b[0] - a[0], (a[1] + b[1]) / 2 * (b[0] - a[0])) for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(p[4] for p in parts), 0.0, None
    for t, lo, hi, width, area in parts:
        y = share * F.lit(whole) - F.lit(before)
        slope = (hi - lo) / width
        at = F.lit(t) + F.lit(2.0) * y / (F.lit(lo) + F.sqrt(F.greatest(F.lit(0.0), F.lit(lo * lo) + F.lit(2 * slope) * y)))
        out = at if out is None else F.when(share * F.lit(whole) < F.lit(before), out).otherwise(at)
        before += area
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def source_targets(sizes: DataFrame, most: int = 3, weights: int = 3) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh 1, 2, ... ``weights``, repeating. They share all words by weight;
    a target stops at ``most`` times its source's size and the excess is reshared by weight. In order of
    most * size / weight the sources that stop are the first ones, which a running sum finds. One row a
    source: the tables here have as many rows as there are sources.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    order = W.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    run = ranked.select("*", F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0)).alias("capped"), F.coalesce(F.sum("weight").over(upto), F.lit(0)).alias("light"), F.sum("source_size").over(W.partitionBy()).alias("total"), F.sum("weight").over(W.partitionBy()).alias("heavy"))
    level = (F.col("total") - F.col("capped")).cast("double") / (F.col("heavy") - F.col("light"))
    run = run.withColumn("level", level).withColumn("free", F.col("source_size") * most >= F.col("level") * F.col("weight"))
    share = F.min(F.when(F.col("free"), F.struct("capped", "light"))).over(W.partitionBy())
    run = run.withColumn("s", share)
    rest = F.col("weight") * (F.col("total") - F.col("s.capped")).cast("double") / (F.col("heavy") - F.col("s.light"))
    return run.select("source", "source_size", "weight", F.least((F.col("source_size") * most).cast("double"), rest).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, schedules: dict[int, list[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """All columns of ``docs`` and ``size, source_size, target, taken, whole, part, position``.

    A source's documents are taken in whole epochs (``whole`` times each) and, of the last epoch, from its
    hashed order up to the target; the document there is taken in ``part``. taken = whole * size + part.
    ``position``: training times (0..1) of the document's copies, ascending. Hot sources are split: running
    sums go by (source, leading digits of the hash), and only sums of those are added up per source. Null
    texts have size 0; sources of size 0 have target 0; rows that repeat are taken each for itself, and a
    rerun gives the same (rows that agree in id and size may swap). An empty table gives no rows. Columns of
    ``docs`` with the names of results are replaced.
    """
    made = ["size", "source_size", "target", "taken", "whole", "part", "position"]
    kept = [c for c in docs.columns if c not in made or c in (id, text, source)]
    base, (id, text, source), _ = plain_columns(docs.select(*kept), id, text, source)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))), F.col("size").cast("string")))
    # one plain key without nulls, so that the window's partitioning serves the join too and texts move once
    of = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = base.withColumn("size", words_in(text)).withColumn("_key", key).withColumn("_lot", F.substring("_key", 1, 3)).withColumn("_src", of)
    lots = rows.groupBy("_src", "_lot").agg(F.sum("size").alias("n"))
    named = F.when(F.col("_src") != "", F.expr("substring(_src, 2)"))
    targets = source_targets(lots.groupBy("_src").agg(F.sum("n").alias("source_size")).select(named.alias("source"), "source_size"), most)
    targets = targets.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    earlier = W.partitionBy("_src").orderBy("_lot").rowsBetween(W.unboundedPreceding, -1)
    starts = lots.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(targets, "_src").select("_src", "_lot", "_before", "source_size", "weight", "target")
    inside = W.partitionBy("_src", "_lot").orderBy("_key", id).rowsBetween(W.unboundedPreceding, -1)
    met = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_src", "_lot"])
    met = met.withColumn("_at", F.col("_before") + F.col("_in")).withColumn("_words", F.floor("target"))
    met = met.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(F.lit(0)).cast("long"))
    met = met.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - F.col("whole") * F.col("source_size") - F.col("_at"))).cast("long"))
    met = met.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    copies = F.when((F.col("taken") > 0), F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("part") > 0, 0).otherwise(1))).otherwise(F.array().cast("array<bigint>"))

    def place(copy: Column) -> Column:
        share = (copy * F.col("source_size") + F.col("_at")).cast("double") / F.col("target")
        out = None
        for w, knots in schedules.items():
            at = invert_demand(share, knots)
            out = at if out is None else F.when(F.col("weight") == w, at).otherwise(out)
        return out

    return met.withColumn("position", F.transform(copies, place)).select(*base.columns, *made).toDF(*kept, *made)


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself in training order: a row for each copy taken, with the columns of ``docs``.

    The document in which a source reaches its target appears once cut after its last word taken, with
    ``n_chars`` counted anew. Documents of which nothing is taken are left out.
    """
    plain, (id, text, source), restored = plain_columns(docs, id, text, source)
    mixed = mix(plain, id, text, source).where("taken > 0")
    copies = mixed.select("*", F.posexplode("position").alias("_copy", "_time"))
    cut_here = (F.col("_copy") == F.col("whole")) & (F.col("part") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    out = copies.withColumn(text, F.when(cut_here, head).otherwise(F.col(text)))
    if n_chars in docs.columns:
        n = f"c{docs.columns.index(n_chars)}"
        out = out.withColumn(n, F.when(cut_here, F.length(text).cast("long")).otherwise(F.col(n)))
    return restored(out.orderBy("_time", id, "_copy"))
