"""Helpers that several corpus operators use: the shared folder, written tables, linked components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is missing and Spark runs inside one machine (tests);
    a cluster without the setting is an error, because executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one job, below a folder of their own; ``clear`` deletes them when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark).rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only, as URL hosts and word shingles need it."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 40, put: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component = the smallest node reached.

    Alternates the large-star and small-star steps; each round is written to the shared folder, so a round's work
    is never repeated. Minima are taken by partial aggregation and written, so that the join back to the edges is one of
    two plain inputs, which adaptive execution can split: a hub with very many neighbours doesn't land in one task.
    ``put`` writes a table. Nulls and self-links are ignored; no edges give no rows. Ends when a round changes nothing; more than ``rounds``
    rounds is an error.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = put(e.where("u is not null and v is not null and u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = put(large.where("u <> v").distinct(), "large")
        low = put(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = put(star, "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("the components did not settle")
