"""Mixing sources to target weights by fitting a word budget exactly.

Documents are counted by source and exact length. A source's target is met by whole passes over the source, then by a
share of each length, then by a bounded-knapsack dynamic programme over the lengths for what is left of the budget.
The documents of each length are then chosen in a seeded order until its count is reached.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 7
#: Parts of one (source, length) by seeded hash, so that very many documents of one length are ranked in many tasks.
PARTS = 256
#: Words of budget that are left to the dynamic programme, at most twice as many.
FIT = 1 << 15


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all words; a target stops
    at ``most`` times its source's size, and the rest shares the excess by weight until none is above. With sources
    ordered by that limit over weight, the level at which this ends follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * float(most))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", (F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1))).alias("c"), (F.sum("w").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing))).alias("rest"), (F.sum("source_size").over(everything) * float(share)).alias("budget"))
    level = (F.col("budget") - F.coalesce("c", F.lit(0.0))) / F.col("rest")
    rows = rows.withColumn("level", F.max(F.when(level <= F.col("cap") / F.col("w"), level)).over(everything))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near ``budget`` as they can.

    A common share of every length comes first, then long lengths while more than FIT words are left, then a bounded
    knapsack over the words that remain: reachable sums are bits of one number, counts are split into powers of two.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    take = np.minimum(counts, (counts * min(1.0, budget / total)).astype(np.int64))
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= FIT:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), max(0, (left - FIT // 2) // int(lengths[i])))
            take[i] += more
            left -= more * int(lengths[i])
    while left > 2 * FIT:  # all that remain are long: one at a time, the nearest to what is left
        open_ = np.flatnonzero((counts > take) & (lengths > 0))
        best = open_[np.argmin(np.abs(lengths[open_] - left))] if len(open_) else None
        if best is None or abs(int(lengths[best]) - left) >= left:
            return take
        take[best] += 1
        left -= int(lengths[best])
    if left <= 0:
        return take
    items, reach, steps = [], 1, []
    for i in np.flatnonzero((counts > take) & (lengths > 0) & (lengths <= 2 * left)):
        free, part = min(int(counts[i] - take[i]), 2 * left // int(lengths[i])), 1
        while free > 0:
            part = min(part, free)
            items.append((int(i), part))
            steps.append(reach)
            reach |= (reach << part * int(lengths[i])) & ((1 << 2 * left + 1) - 1)
            free, part = free - part, part * 2
        if reach >> left & 1:
            break
    below = (reach & ((1 << left + 1) - 1)).bit_length() - 1
    above = left + ((reach >> left) & -(reach >> left)).bit_length() - 1 if reach >> left else 2 * left + 1
    at = below if left - below <= above - left else above
    for (i, part), before in zip(reversed(items), reversed(steps), strict=True):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """The lengths of one source: a row for each, however many documents it has."""
    frame = frame.sort_values("size")
    size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    passes = min(MOST, int(target // size)) if size else 1
    frame["passes"] = passes
    frame["extra"] = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), round(target) - passes * size) if passes < MOST else 0
    return frame[["skey", "size", "source_size", "target", "passes", "extra"]]


def mix(docs: DataFrame, seed: int = SEED, carry: bool = False) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for every row of ``docs(doc_id, text, source)``.

    ``taken`` is ``size`` times ``copies``, and copies are 2 at most; with ``carry`` there are
    ``copies`` and the whole row of ``docs`` as the struct ``_row`` only. Nulls: a null text has no words; null is a source of its own, after all others;
    a null doc_id is kept. Documents without words fit any budget and go along with each whole pass (once if all of a
    source's are empty). Ties and repeated rows: the seeded hash of doc_id and text decides, and which of two equal
    rows is taken makes no difference. Very long texts: whole. Empty table: no rows. Other columns are not read, or pass through.
    """
    rows = docs.select(
        *([F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if carry else []),
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"),
        F.xxhash64(docs["doc_id"].cast("long"), F.crc32(docs["text"].cast("binary")), F.lit(seed)).alias("h"),
    )
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    cells = written(rows.groupBy("skey", "source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "cells")
    lengths = cells.groupBy("skey", "source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("skey", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = targets(sources.select("source", "source_size")).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "source_size", "target")
    plan = lengths.select("skey", "size", "n").join(aims, "skey").groupBy("skey").applyInPandas(_plan, "skey string, size long, source_size long, target double, passes long, extra long")
    run = Window.partitionBy("skey", "size").orderBy("part")
    quotas = cells.join(plan, ["skey", "size"]).select("skey", "size", "part", "source_size", "target", "passes", F.greatest(F.lit(0), F.col("extra") - (F.sum("n").over(run) - F.col("n"))).alias("quota"))
    quotas = written(quotas, "quotas")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("h", "doc_id"))
    chosen = rows.drop("source").withColumn("rank", rank).join(quotas, ["skey", "size", "part"])
    copies = (F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)).cast("int")
    if carry:
        return chosen.select("_row", copies.alias("copies"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, one after the other, with its columns whatever their names.

    Odd rows go as in ``mix``.
    """
    rows = mix(docs, seed, carry=True).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_mixing": op6_mixing}
