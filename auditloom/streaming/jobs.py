"""Streaming jobs: lines to batches, records to buckets, ticks to incidents, alerts to the outbox, pages to the snapshot.

Micro-batches are written under their batch id, so a repeated one replaces itself. State is keyed by what the batch
operators group by; a stream over input split into files gives what the batch operator gives over all of it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Config
from ..functions import scalars as S
from ..operators import alerts as A
from ..operators import gates as G
from ..operators import issues as IS
from ..operators import snapshots as SN
from ..operators import stability as ST
from ..operators.batching import make_batches
from ..operators.incidents import FIELDS, NOTHING, REEMIT_SECONDS, TTL_SECONDS, next_state
from ..sources import logs as L
from ..sources.staging import parquet_or_none, staged


def read_lines(spark: SparkSession, folder: str, schema: str = "path string, from_offset bigint, to_offset bigint, line_no bigint, line string") -> DataFrame:
    """A stream of landed line tables (files are not changed after they land)."""
    return spark.readStream.schema(schema).parquet(folder)


def _start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", once: bool = True, **sink) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if once:
        writer = writer.trigger(availableNow=True)
    if each:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").options(**sink).start()


def batches_job(lines: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Suspicious lines, packed into redacted batches, appended to ``folder``."""

    def each(df: DataFrame, batch: int) -> None:
        make_batches(G.suspicious_lines(df)).write.mode("overwrite").parquet(f"{folder}/run={batch}")

    return _start(lines, checkpoint, each, once=once)


def follow_files(spark: SparkSession, logs: str, folder: str) -> int:
    """One pass over growing files: new complete lines since the ledger become batches, then the ledger moves on.

    The chunks are written first, and both batches and ledger come from what was written: a line that is appended
    meanwhile waits for the next pass. The ledger is written under a number of its own after the batches, so a failed
    pass is done again from the old one. Of a file no more is read than what is new and both ends of what is known.
    """
    versions = f"{folder}/ledger"
    last = parquet_or_none(spark, versions)
    number = -1 if last is None else last.agg(F.max("version")).first()[0]
    ledger = spark.createDataFrame([], L.LEDGER) if last is None else last.where(F.col("version") == number).drop("version")
    landed = f"{folder}/chunks/run={number + 1}"
    L.new_chunks(L.listed(spark, logs), ledger, whole=False).write.mode("overwrite").parquet(landed)
    chunks = spark.read.parquet(landed)
    make_batches(G.suspicious_lines(L.split_lines(chunks))).write.mode("overwrite").parquet(f"{folder}/batches/run={number + 1}")
    L.next_ledger(ledger, chunks.select("path", "to_offset", "fingerprint")).write.mode("overwrite").parquet(f"{versions}/version={number + 1}")
    return number + 1


def bucket_stream(records: DataFrame, cfg: Config, delay: str = "2 hours") -> DataFrame:
    """Failures and totals by component and tumbling event-time bucket, closed once the watermark has passed.

    Attempts are rows of their own (``attempt``): they count for coverage, not for a component. Records behind the watermark
    are dropped; Spark counts them in the query's progress (``numRowsDroppedByWatermark``). The batch path has no such
    limit: it counts all records again each time.
    """
    dated = records.withColumn("_epoch", S.epoch_of("occurredAtUtc")).where("_epoch is not null").withColumn("ts", F.timestamp_seconds("_epoch"))
    attempt = (G.is_attempt("action") | (S.text("action") == "")).alias("attempt")
    keys = [S.action_family("action").alias("family"), S.text("scopeId").alias("scope"), S.text("resourceType").alias("rtype"), attempt, F.window("ts", f"{cfg.bucket_minutes} minutes").alias("w")]
    counted = dated.withWatermark("ts", delay).groupBy(*keys).agg(F.count_if(G.is_failure("action", "outcome")).alias("fails"), F.count(F.lit(1)).alias("total"))
    return counted.select("family", "scope", "rtype", S.bucket_of(F.unix_seconds("w.start"), cfg.bucket_seconds).alias("bucket"), "attempt", "fails", "total")


def late_job(records: DataFrame, folder: str, checkpoint: str, cfg: Config, delay_seconds: int = 7200, once: bool = True) -> StreamingQuery:
    """How many dated records came after their bucket was closed: ``(bucket, late)`` of each batch, in ``folder/late``.

    A bucket is closed once it ends at or before the newest time of the batches before, less the delay: then ``bucket_stream`` drops
    its records, and Spark's own figure counts them after they were combined. The newest time is kept beside, a row a batch.
    """
    spark = records.sparkSession

    def each(df: DataFrame, batch: int) -> None:
        marks = parquet_or_none(spark, f"{folder}/newest") if batch else None
        mark = None if marks is None else marks.where(F.col("run") < batch).agg(F.max("epoch")).first()[0]
        dated = df.select(S.epoch_of("occurredAtUtc").alias("epoch")).where("epoch is not null").withColumn("bucket", S.bucket_of(F.col("epoch"), cfg.bucket_seconds))
        late = dated.where((F.col("bucket") + 1) * cfg.bucket_seconds <= F.lit(mark).cast("bigint") - delay_seconds)
        late.groupBy("bucket").agg(F.count(F.lit(1)).alias("late")).write.mode("overwrite").parquet(f"{folder}/late/run={batch}")
        dated.agg(F.max("epoch").alias("epoch")).write.mode("overwrite").parquet(f"{folder}/newest/run={batch}")

    return _start(records, checkpoint, each, once=once)


def scan_job(records: DataFrame, folder: str, checkpoint: str, cfg: Config, once: bool = True) -> StreamingQuery:
    """All rules for audit records as of the newest bucket, after each micro-batch of ``records``.

    Events are kept in folders by bucket, and a scan reads those of the lookback only. Everything in them is counted
    again, so a late record changes its bucket. Attempts extend the coverage, so a component that is silent in the newest
    bucket is quiet, not unknown.
    """
    spark, depth = records.sparkSession, max(cfg.lookback_buckets, cfg.flap_buckets)

    def each(df: DataFrame, batch: int) -> None:
        ST.stability_events(df, cfg, line=True).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/events/run={batch}")
        events = parquet_or_none(spark, f"{folder}/events")
        last = None if events is None or "bucket" not in events.columns else events.agg(F.max("bucket")).first()[0]
        if last is None:
            return
        recent = events.where(F.col("bucket") > last - depth).withColumn("bucket", F.col("bucket").cast("bigint"))
        told = ST.rules(staged(ST.bucket_counts(recent), "scan"), cfg).where(F.col("bucket") == last)
        fp = S.fingerprint(F.col("signal"), F.col("family"), F.col("scope"), F.col("rtype"))
        told.withColumn("fp", fp).write.mode("overwrite").parquet(f"{folder}/candidates/run={batch}")

    return _start(records, checkpoint, each, once=once)


def issues_job(requests: DataFrame, folder: str, checkpoint: str, issues: Callable[[], DataFrame], cfg: Config, login: str = "", once: bool = True, ticks: DataFrame | None = None, now: Callable[[], int] | None = None) -> StreamingQuery:
    """Decisions on issue requests, those that wait carried over: each run takes up the pending ones of the run before it.

    A run writes its decisions, then what is done, then what still waits; a repeated run starts from the same tables. What was
    refused for a budget, or waits because nothing is written, comes up again in reconcile order. ``ticks`` is a stream of
    any rows, each of which makes a run, so that what waits is taken up without new requests. A request that can't be served is
    told in its own row (``decision`` error) and stops no other.

    What is done is kept for 30 days before ``now()``, by default the clock's seconds: a run adds its own rows, and reads the
    others' that are young enough.
    """
    spark, clock = requests.sparkSession, now or (lambda: int(time.time()))
    fields = requests.columns

    def each(df: DataFrame, batch: int) -> None:
        waits = parquet_or_none(spark, f"{folder}/pending/run={batch - 1}") if batch else None
        asked = df.where(~F.col("_tick")).select(*fields)
        asked = asked if waits is None else waits.unionByName(asked)
        done, at = parquet_or_none(spark, f"{folder}/done"), clock()
        done = spark.createDataFrame([], "repo string, dedup_key string") if done is None else done.where((F.col("run") < batch) & (F.col("at") > at - IS.DONE_TTL))
        decided = staged(IS.decide(asked, issues(), done.select("repo", "dedup_key"), cfg, login), "decided")
        IS.reconcile_order(decided).write.mode("overwrite").parquet(f"{folder}/decisions/run={batch}")
        finished = decided.where("decision in ('file', 'comment', 'close', 'skip')").select("repo", "dedup_key", F.lit(at).cast("bigint").alias("at")).distinct()
        finished.write.mode("overwrite").parquet(f"{folder}/done/run={batch}")
        IS.next_pending(decided).select(*fields).write.mode("overwrite").parquet(f"{folder}/pending/run={batch}")

    both = requests.withColumn("_tick", F.lit(False))
    if ticks is not None:
        both = both.unionByName(ticks.select(F.lit(True).alias("_tick")), allowMissingColumns=True)
    return _start(both, checkpoint, each, once=once)


def unseen_stream(records: DataFrame, ttl: str = "7 days") -> DataFrame:
    """Records whose (source, id) didn't come in the last seven days of event time."""
    return records.withColumn("ts", F.timestamp_seconds(S.epoch_of("occurredAtUtc"))).where("id <> '' and ts is not null").withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["source_id", "id"]).drop("ts")


def suppressed_stream(alerts: DataFrame, ttl: int = A.SENT_TTL, filed_ttl: int = A.FILED_TTL) -> DataFrame:
    """``alerts(dedup_key, category, at, seq)`` with ``sent``, as ``operators.alerts.suppress`` tells it, by the alerts' own times.

    A key's state is the second that its time counts from. An alert about a filed issue moves it on, others don't. Batches are to
    come in order of time; within one, rows are put in order, and of equal seconds only the first can be sent.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ARG001
        mark = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        sent, last = [], None
        for at, category in zip(rows["at"], rows["category"], strict=True):
            filed = category == "issue-filed"
            send = at != last and (mark is None or at >= mark + (filed_ttl if filed else ttl))
            if send or (filed and at != last):
                mark = at
            last = at
            sent.append(send)
        state.update((int(mark),))
        yield rows.assign(sent=sent)[["dedup_key", "category", "at", "seq", "sent"]]

    narrow = alerts.select("dedup_key", "category", F.col("at").cast("bigint").alias("at"), F.col("seq").cast("bigint").alias("seq"))
    return narrow.groupBy("dedup_key").applyInPandasWithState(fold, "dedup_key string, category string, at bigint, seq bigint, sent boolean", "mark bigint", "append", "NoTimeout")


EVENT_SCHEMA = "fp string, seq long, tick_id string, fired boolean, quiet_ok boolean, latest_bucket string, state string, open_bucket string, last_fired_tick string, quiet_count int, last_quiet_bucket string, action string"
STATE_SCHEMA = "state string, open_bucket string, last_fired_tick string, quiet_count int, last_quiet_bucket string, seq long, emitted long"


def incident_stream(ticks: DataFrame, cfg: Config, seconds_a_tick: int | None = None) -> DataFrame:
    """Every tick's state as it comes: ``ticks(fp, seq, tick_id, fired, quiet_ok, latest_bucket)``.

    The state of a fingerprint is one row. With ``seconds_a_tick`` a closed incident is forgotten when a tick comes 14
    days after its last one, and an open one that still fires asks to be opened again ten minutes after it last did; both
    by the ticks' own time, so the job ends when its input does.
    """
    start = (*NOTHING, -1, -1)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else start
        now, last, emitted = dict(zip(FIELDS, held[:5], strict=True)), held[5], held[6]
        rows = []
        for tick in pd.concat(list(frames)).sort_values("seq").to_dict("records"):
            if seconds_a_tick and now["state"] == "closed" and (tick["seq"] - last) * seconds_a_tick > TTL_SECONDS:
                now = dict(zip(FIELDS, NOTHING, strict=True))
            now, action = next_state(now, tick, cfg.quiet_windows)
            last = tick["seq"]
            if seconds_a_tick and not action and now["state"] == "open" and tick["fired"] and (last - emitted) * seconds_a_tick >= REEMIT_SECONDS:
                action = "open"
            if action == "open":
                emitted = last
            rows.append({**{k: tick[k] for k in ("fp", "seq", "tick_id", "fired", "quiet_ok", "latest_bucket")}, **now, "action": action})
        state.update((*(now[f] for f in FIELDS), int(last), int(emitted)))
        yield pd.DataFrame(rows)

    return ticks.groupBy("fp").applyInPandasWithState(fold, EVENT_SCHEMA, STATE_SCHEMA, "append", "NoTimeout")


def alerts_job(alerts: DataFrame, folder: str, checkpoint: str, now: Callable[[], int], writing: bool, once: bool = True) -> StreamingQuery:
    """Alerts to the outbox: each run writes its rows, acknowledgements, rejects and the new ledger, in that order."""
    spark = alerts.sparkSession

    def each(df: DataFrame, batch: int) -> None:
        ledger = spark.createDataFrame([], "dedup_key string, sent_at bigint, filed boolean")
        if batch > 0:
            ledger = spark.read.parquet(f"{folder}/ledger/run={batch - 1}")
        rows, kept, acks, bad = A.outbox(df, ledger, now(), writing)
        for name, part in (("outbox", rows), ("acks", acks), ("quarantine", bad), ("ledger", kept)):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/run={batch}")

    return _start(alerts, checkpoint, each, once=once)


def snapshot_job(records: DataFrame, folder: str, checkpoint: str, cfg: Config, once: bool = True) -> StreamingQuery:
    """Records (with ``arrival``) merged into the snapshot; readers see the old version until the new one is whole."""
    spark = records.sparkSession

    def each(df: DataFrame, batch: int) -> None:
        path = SN.publish(SN.merge_snapshot(SN.current(spark, folder), df, cfg.snapshot_rows), folder)
        SN.switch(spark, folder, path)
        SN.expire(spark, folder)

    return _start(records, checkpoint, each, once=once)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return _start(stream, checkpoint, once=once, path=path)
