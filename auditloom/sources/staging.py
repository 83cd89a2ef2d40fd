"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs inside one machine, a temporary folder of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet and read back: computed once, however often it is used, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing is there yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


#: Rows of one task where heavy expressions follow.
ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, the rows of a table, over all cores and at most about ROWS to a task; heavy expressions follow.

    However few parts or groups of rows its files have: a part without a group of rows of its own has nothing to do. The rows
    of Parquet files are counted from their footers.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS)))
