"""The snapshot of newest records: merged by key, ordered, published as a whole; ids that were seen before."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import AUDIT_FIELDS

SEEN_TTL = 7 * 86_400


def record_key() -> Column:
    """The id, or the whole record as JSON where there is none."""
    return F.when(F.col("id") != "", F.col("id")).otherwise(F.to_json(F.struct(*AUDIT_FIELDS)))


def merge_snapshot(old: DataFrame | None, new: DataFrame, rows: int) -> DataFrame:
    """The newest ``rows`` records of both, the later arrival (column ``arrival``) of a key winning; old ones came before all new ones.

    A key's latest version is an aggregate, so a key that comes very often is combined before it is shuffled.
    """
    both = new if old is None else old.select(*AUDIT_FIELDS, F.lit(-1).cast("bigint").alias("arrival")).unionByName(new.select(*AUDIT_FIELDS, F.col("arrival").cast("bigint").alias("arrival")))
    latest = both.withColumn("_key", record_key()).groupBy("_key").agg(F.max_by(F.struct(*AUDIT_FIELDS), F.struct("arrival", *AUDIT_FIELDS)).alias("r"))
    return latest.select("r.*", "_key").orderBy(F.desc("occurredAtUtc"), F.desc("_key")).limit(rows).drop("_key")


def publish(df: DataFrame, folder: str) -> str:
    """Write a new version beside the others; readers go by the pointers, so nothing changes for them yet."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Numbered pointers, the newest first: those that ``expire`` has left."""
    try:
        found = spark.read.text(f"{folder.rstrip('/')}/pointers").select(F.col("number").cast("bigint"), "value").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    return sorted(((n, path) for n, path in found), reverse=True)


def switch(spark: SparkSession, folder: str, path: str) -> int:
    """Make ``path`` the current version, after all its data is there, and give the pointer's number.

    A pointer is one file of one row that appears by a single rename, beside the older ones: whenever a writer stops, readers see
    the old version or the new one. There is one writer.
    """
    number = max((n for n, _ in _pointers(spark, folder)), default=-1) + 1
    where = f"{folder.rstrip('/')}/pointers/number={number}"
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").text(where)  # what is there has no row: a writer stopped
    return number


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The version of the greatest pointer, or None before the first one; a version that can't be read is an error."""
    found = _pointers(spark, folder)
    return spark.read.parquet(found[0][1]) if found else None


def expire(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete versions and pointers older than the newest ``keep``, and versions that no pointer names; how many versions went.

    For the writer, between its writes. Readers of the newest ``keep`` versions aren't disturbed. Pointers go first, so none
    names a version that is gone.
    """
    found = _pointers(spark, folder)
    named = {path.rstrip("/").rpartition("/")[2] for _, path in found[:keep]}
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for number, _ in found[keep:]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"pointers/number={number}"), True)
    gone = [f.getPath() for f in system.listStatus(root) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in named]
    for path in gone:
        system.delete(path, True)
    return len(gone)


def unseen(records: DataFrame, ledger: DataFrame, now: int, revision: str = "risk-v2") -> DataFrame:
    """Records with an id that the ledger ``(source_id, id, at)`` doesn't have from the last seven days.

    The rules' revision is a part of the source, so a change of rules looks at everything again. Records without id are ignored.
    """
    live = ledger.where(F.col("at") > now - SEEN_TTL).select("source_id", "id")
    keyed = records.where("id <> ''").withColumn("source_id", F.concat_ws("/", "source_id", F.lit(revision)))
    return keyed.dropDuplicates(["source_id", "id"]).join(live, ["source_id", "id"], "left_anti")
