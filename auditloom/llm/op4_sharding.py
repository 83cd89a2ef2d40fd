"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 without a gap in an order that their contents decide; equal rows are counted together. A Feistel network permutes the numbers;
it works on the smallest a x b grid that holds them, so a number that leaves the range walks on along its cycle until it
is back. The permuted number p gives shard ``p mod shards`` and slot ``p div shards``: a reproducible shuffle whose shard
sizes differ by one at most. Only columns and built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

SHARDS, SEED, ROUNDS = 40, 20_240_101, 6
#: Parts in which rows are numbered: more parts, smaller sorts. A fixed number, so it decides no result's size.
PARTS = 4096
#: Numbers of equal rows that one task makes.
CHUNK = 100_000
#: Steps of a walk. A grid has fewer than sqrt(rows) + 1 numbers out of range, so a longer walk is not met; it would be an error.
WALK = 64


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row`` (0, 1, ... over all rows) and ``rows`` (how many there are).

    Equal rows are interchangeable, so they are counted together first, before anything is shuffled. Distinct rows are
    numbered part by part, the part being a hash of all columns; parts are counted and their running sum, PARTS numbers, is
    broadcast. Then each distinct row gives its numbers, very many of them in chunks that are dealt out.
    """
    order = rows.columns
    cells = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy(*order)) - F.col("_n")
    cells = written(cells.withColumn("_within", within), "cells")
    sums = Window.orderBy("_part")
    counts = cells.groupBy("_part").agg(F.sum("_n").alias("_all"))
    counts = counts.select("_part", (F.sum("_all").over(sums) - F.col("_all")).alias("_before"), F.sum("_all").over(sums.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rows"))
    placed = cells.join(F.broadcast(counts), "_part").withColumn("_first", F.col("_before") + F.col("_within")).select(*order, "_n", "_first", "rows")
    few = placed.where(F.col("_n") <= CHUNK).select(*order, "rows", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_at"))
    parts = placed.where(F.col("_n") > CHUNK).select(*order, "rows", "_n", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / CHUNK).cast("long") - 1)).alias("_chunk"))
    parts = parts.repartition(*order, "_chunk")
    many = parts.select(*order, "rows", "_first", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_n"), (F.col("_chunk") + 1) * CHUNK) - 1)).alias("_at"))
    return few.unionByName(many).withColumn("row", F.col("_first") + F.col("_at")).drop("_first", "_at")


def feistel(x: Column, wide: Column, high: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. wide * high - 1: the halves of a number on the grid add keyed hashes of each other in turn."""
    left = F.pmod(x, wide)
    right = ((x - left) / wide).cast("long")  # exact: below 2^53 on a grid of under 2^53 numbers
    for k in range(rounds):
        if k % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed + k)), high), high)
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed + k)), wide), wide)
    return left + right * wide


def permuted(row: Column, rows: Column, seed: int) -> Column:
    """The number that ``row`` goes to, 0 .. rows - 1."""
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(rows.cast("double")))).cast("long")
    high = F.floor((rows + wide - 1) / wide).cast("long")
    step = lambda x: feistel(x, wide, high, seed)
    first = step(row)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda at, _: F.when(at < rows, at).otherwise(step(at)))
    return F.when(first < rows, first).otherwise(F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long")))


def shards(docs: DataFrame, n: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A shard (0 .. n - 1) and a gapless slot for every row of ``docs(doc_id, text)``, under the law ``rows``.

    ``grown_shard`` is null: this law moves rows if the number of shards changes. Equal texts need not share a shard.
    Nulls: a null text has size 16 and the checksum of no bytes; a null doc_id comes first in its part. Very long texts:
    whole, by built-in functions. Ties and repeated rows: each has its own slot. Empty table: no rows. Other columns are not
    read.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = numbered(rows).withColumn("at", permuted(F.col("row"), F.col("rows"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("at", F.lit(n)).cast("int").alias("shard"),
        ((F.col("at") - F.pmod("at", F.lit(n))) / n).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
