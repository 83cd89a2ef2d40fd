"""The outbox of filed issues: reserved before an issue is made, final with its number, gone when acknowledged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .gates import ack_error, filed_alert_key

IDENTITY = ["schema", "repo", "fingerprint", "signal", "severity", "title", "incident_id", "request_dedup_key"]
MOST, RERAISE_SECONDS = 256, 300


COLUMNS = ["schema", "repo", "issue_number", "fingerprint", "signal", "severity", "title", "incident_id", "request_dedup_key", "alert_dedup_key", "phase"]


def _records(requests: DataFrame, number: Column, alert_key: Column, phase: str) -> DataFrame:
    given = {"schema": F.lit("issues.filed-alert.v1"), "issue_number": number, "severity": F.lower("severity"), "request_dedup_key": F.col("dedup_key"), "alert_dedup_key": alert_key, "phase": F.lit(phase)}
    return requests.select(*(given.get(c, F.col(c)).alias(c) for c in COLUMNS))


def reserve(requests: DataFrame) -> DataFrame:
    """Reservations for requests that are about to be filed."""
    return _records(requests, F.lit(""), F.lit(""), "reserved")


def finalize(requests: DataFrame) -> DataFrame:
    """Final records for requests whose issue has a ``number``; a number below 1 is an error."""
    number = F.when(F.col("number") >= 1, F.col("number").cast("bigint")).otherwise(F.raise_error(F.lit("a filed issue needs a number of 1 or more")).cast("bigint")).cast("string")
    return _records(requests, number, filed_alert_key(F.col("repo"), number), "finalized")


def merge(records: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records after ``changes``, and changes in conflict.

    Identity fields never change, a number is bound once, and a phase only moves on: a reservation after the final record
    alters nothing. A set may have several changes of one key: they count in order of ``seq`` where the changes have that
    column, else reservations first and by number. The first one makes a new record's identity; a final one binds the number.
    Each key's changes are reduced before they meet the records, so a key that comes very often is combined where it is read.
    """
    key = ["repo", "request_dedup_key"]
    seq = F.col("seq").cast("bigint") if "seq" in changes.columns else F.lit(0).cast("bigint")
    number = F.struct(F.length("issue_number"), "issue_number")
    given = changes.select(*COLUMNS, F.struct(seq, F.col("phase") == "finalized", number, *IDENTITY).alias("_order"), F.struct(*IDENTITY).alias("_own"))
    held = records.select(*key, F.struct(*IDENTITY).alias("_old"), *(F.col(c).alias(f"_old_{c}") for c in ("issue_number", "alert_dedup_key", "phase")))
    bound = held.join(given.groupBy(*key).agg(F.min_by("_own", "_order").alias("_new")), key, "full_outer").withColumn("_identity", F.coalesce("_old", "_new")).drop("_old", "_new")
    judged = given.join(bound, key).withColumn("_changed", F.col("_own") != F.col("_identity"))
    final = judged.where("phase = 'finalized' and not _changed").groupBy(*key).agg(F.min_by(F.struct("issue_number", "alert_dedup_key"), "_order").alias("_final"))
    bound = bound.join(final, key, "left")
    kept = F.coalesce(F.col("_old_phase") == "finalized", F.lit(False))  # its number stays
    done = kept | F.col("_final").isNotNull()
    told = {c: F.when(kept, F.col(f"_old_{c}")).when(done, F.col("_final")[c]).otherwise("") for c in ("issue_number", "alert_dedup_key")} | {"phase": F.when(done, "finalized").otherwise("reserved")}
    told |= {c: F.col("_identity")[c] for c in IDENTITY if c not in key}
    merged = bound.select(*(told.get(c, F.col(c)).alias(c) for c in COLUMNS))
    judged = judged.join(merged.select(*key, F.col("issue_number").alias("_bound")), key)
    conflicts = judged.where(F.col("_changed") | ((F.col("phase") == "finalized") & (F.col("issue_number") != F.col("_bound"))))
    return merged, conflicts.select(*COLUMNS)


def acknowledge(records: DataFrame, acks: DataFrame) -> DataFrame:
    """Records without those that a valid acknowledgement names by repository, number and alert key."""
    valid = acks.where(ack_error().isNull()).select("repo", F.col("issue_number").cast("string").alias("issue_number"), F.col("dedup_key").alias("alert_dedup_key"))
    return records.join(valid, ["repo", "issue_number", "alert_dedup_key"], "left_anti")


def due(records: DataFrame, now: int) -> DataFrame:
    """Final records whose alert is raised again: those not acknowledged five minutes after ``raised_at``."""
    return records.where((F.col("phase") == "finalized") & (F.coalesce("raised_at", F.lit(0)) + RERAISE_SECONDS <= now))


def checked(records: DataFrame, most: int = MOST) -> DataFrame:
    """The records, unless there are more than the outbox may hold."""
    if records.limit(most + 1).count() > most:
        raise ValueError(f"the outbox holds more than {most} records")
    return records


def outbox_id():
    return S.sha_hex(F.concat_ws("\x1f", "repo", "request_dedup_key"), 32)
