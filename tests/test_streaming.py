"""Streams over input split into files give what the batch operators give over all of it."""

import pytest
from pyspark.sql import functions as F

from auditloom.config import Config
from auditloom.operators import incidents as I
from auditloom.operators import stability as ST
from auditloom.operators.batching import make_batches
from auditloom.operators.gates import suspicious_lines
from auditloom.schemas import ISSUE
from auditloom.sources.adapter import audit_records, table
from auditloom.streaming import jobs as J

DATA = "/root/testdata/sf0.001"
CFG = Config.of(bucket_minutes=1440)


@pytest.fixture(scope="module")
def records(spark):
    return audit_records(table(spark, DATA, "events"))


def split(df, path, column, n=3):
    """Write ``df`` as n files in the order of ``column``."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    for i in range(n):
        a, b = lo + (hi - lo + 1) * i // n, lo + (hi - lo + 1) * (i + 1) // n
        df.where((F.col(column) >= a) & (F.col(column) < b)).coalesce(1).write.mode("append").parquet(path)
    return df.schema


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


def test_incidents(spark, records, tmp_path):
    ticks = I.ticks_of(ST.candidates(records, CFG), CFG).cache()
    schema = split(ticks, f"{tmp_path}/in", "seq")
    J.write_stream(J.incident_stream(stream(spark, schema, f"{tmp_path}/in"), CFG), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() > 0 and same(got, I.timeline(ticks, CFG).select(*got.columns))


def test_closed_buckets(spark, records, tmp_path):
    schema = split(records, f"{tmp_path}/in", "event_id")
    J.write_stream(J.bucket_stream(stream(spark, schema, f"{tmp_path}/in"), CFG), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = ST.component_buckets(ST.stability_events(records, CFG)).join(got.where("not attempt").select(*ST.GROUP, "bucket"), [*ST.GROUP, "bucket"], "left_semi")
    assert got.count() > 100 and same(got.where("not attempt").drop("attempt"), want) and got.where("attempt").count() > 10


def test_scan_of_the_newest_bucket(spark, records, tmp_path):
    schema = split(records, f"{tmp_path}/in", "event_id", n=2)
    J.scan_job(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", CFG).awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out/candidates")
    last = got.agg(F.max("run"), F.max("bucket")).first()
    got = got.where(F.col("run") == last[0]).drop("run")
    recent = ST.candidates(records.where(F.col("occurredAtUtc") >= F.date_format(F.timestamp_seconds(F.lit((last[1] - 7) * 86400)), "yyyy-MM-dd")), CFG).where(F.col("bucket") == last[1])
    assert {r["signal"] for r in got.collect()} == {"recurring-failure", "error-spike", "flapping"} and same(got, recent)


def test_pending_requests_come_up_again_and_open_incidents_ask_again(spark, tmp_path):
    row = lambda i, kind="open", fp=None: ("issues.issue.v1", kind, f"{fp or i:08x}", "error-spike", "high", f"x (fp:{fp or i:08x})", "b", f"inc-{fp or i}", f"k/{kind}/{i}", "org/r", "", i, "2024-01-01")
    columns = "schema string, kind string, fingerprint string, signal string, severity string, title string, body_md string, incident_id string, dedup_key string, repo string, devloop_enabled string, arrival long, day string"
    for n, rows in enumerate(([row(1), row(2), row(3, "comment", 2)], [row(4)])):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.issues_job(spark.readStream.schema(columns).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", lambda: spark.createDataFrame([], ISSUE), CFG.but(max_per_day=1)).awaitTermination(240)
        told = {r["dedup_key"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/out/decisions/run={n}").collect()}
        assert told == ({"k/open/1": "file", "k/open/2": "budget-day", "k/comment/3": "waiting-for-pending-open"} if n == 0 else {"k/open/2": "file", "k/open/4": "budget-day", "k/comment/3": "comment"})
    ticks = spark.createDataFrame([("deadbeef", i, str(i), True, False, "b") for i in range(9)], "fp string, seq long, tick_id string, fired boolean, quiet_ok boolean, latest_bucket string")
    schema = split(ticks, f"{tmp_path}/ticks", "seq")
    J.write_stream(J.incident_stream(stream(spark, schema, f"{tmp_path}/ticks"), CFG, seconds_a_tick=300), f"{tmp_path}/told", f"{tmp_path}/ck2").awaitTermination(240)
    assert [r["seq"] for r in spark.read.parquet(f"{tmp_path}/told").where("action = 'open'").orderBy("seq").collect()] == [1, 3, 5, 7]


def test_batches_of_each_run(spark, records, tmp_path):
    lines = records.select(F.lit("/a.log").alias("path"), F.floor(F.col("event_id") / 300).cast("bigint").alias("from_offset"), F.lit(9).cast("bigint").alias("to_offset"), F.col("event_id").alias("line_no"), F.concat_ws(" ", "action", "outcome", "auditActorId").alias("line"))
    schema = split(lines, f"{tmp_path}/in", "line_no", n=1)
    J.batches_job(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").select("batch_id", "content")
    assert same(got, make_batches(suspicious_lines(lines)).select("batch_id", "content"))


def test_followed_files(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    (logs / "a.log").write_text("denied one\nfine\ndenied t")
    assert J.follow_files(spark, str(logs), out) == 0
    (logs / "a.log").write_text("denied one\nfine\ndenied two\n")
    assert J.follow_files(spark, str(logs), out) == 1
    assert J.follow_files(spark, str(logs), out) == 2
    assert [r["content"] for r in spark.read.parquet(f"{out}/batches").orderBy("run").collect()] == ["denied one", "denied two"]


def test_a_line_that_comes_while_a_pass_runs_is_read_by_the_next(spark, tmp_path, monkeypatch):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    (logs / "a.log").write_text("denied one\n")

    def slow(lines):
        with (logs / "a.log").open("a") as f:
            f.write("denied two\n")
        return make_batches(lines)

    monkeypatch.setattr(J, "make_batches", slow)
    J.follow_files(spark, str(logs), out)
    monkeypatch.undo()
    J.follow_files(spark, str(logs), out)
    assert [r["content"] for r in spark.read.parquet(f"{out}/batches").orderBy("run").collect()] == ["denied one", "denied two"]


def test_an_unreadable_ledger_is_an_error_and_long_additions_are_several_chunks(spark, tmp_path):
    from auditloom.sources import logs as L

    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"denied {i}\n" for i in range(500)))
    chunks = L.new_chunks(L.read_files(spark, str(logs)), spark.createDataFrame([], L.LEDGER), piece_bytes=1000).orderBy("from_offset").collect()
    assert len(chunks) == 6 and "".join(c["chunk"] for c in chunks) == (logs / "a.log").read_text()
    assert all(a["to_offset"] == b["from_offset"] for a, b in zip(chunks, chunks[1:], strict=False))
    (out / "ledger" / "version=0").mkdir(parents=True)
    (out / "ledger" / "version=0" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="(?i)parquet|read|footer"):
        J.follow_files(spark, str(logs), str(out))


def test_alerts_and_unseen_ids(spark, records, tmp_path):
    alerts = spark.createDataFrame([(i, "alerts.alert.v1", "high", "auth", "s", "e", "a", "p", None, f"k{i % 3}", None, None, None) for i in range(9)], "i int, schema string, severity string, category string, summary string, evidence string, action string, source_path string, batch_id string, dedup_key string, repo string, issue_number string, issue_url string")
    schema = split(alerts, f"{tmp_path}/in", "i")
    J.alerts_job(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", lambda: 1000, writing=True).awaitTermination(240)
    modes = [r["mode"] for r in spark.read.parquet(f"{tmp_path}/out/outbox").collect()]
    assert modes.count("real") == 3 and modes.count("duplicate") == 6
    twice = records.unionByName(records).withColumn("source_id", F.lit("s"))
    schema = split(twice, f"{tmp_path}/ids", "event_id")
    J.write_stream(J.unseen_stream(stream(spark, schema, f"{tmp_path}/ids")), f"{tmp_path}/new", f"{tmp_path}/ck2").awaitTermination(240)
    assert spark.read.parquet(f"{tmp_path}/new").count() == records.count()


def test_snapshot(spark, records, tmp_path):
    rows = records.withColumn("arrival", F.col("event_id"))
    schema = split(rows, f"{tmp_path}/in", "event_id")
    cfg = CFG.but(snapshot_rows=50)
    J.snapshot_job(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/snap", f"{tmp_path}/ck", cfg).awaitTermination(240)
    from auditloom.operators import snapshots as SN

    assert same(SN.current(spark, f"{tmp_path}/snap"), SN.merge_snapshot(None, rows, 50))


def test_what_waits_is_taken_up_by_ticks_and_done_requests_expire(spark, tmp_path):
    columns = "schema string, kind string, fingerprint string, signal string, severity string, title string, body_md string, incident_id string, dedup_key string, repo string, devloop_enabled string, arrival long, day string"
    row = lambda i, severity="high": ("issues.issue.v1", "open", f"{i:08x}", "error-spike", severity, f"x (fp:{i:08x})", "b", f"inc-{i}", f"k/{i}", "org/r", "", i, "2024-01-01")
    ticks, clock = spark.range(1), [0]

    def run():
        J.issues_job(spark.readStream.schema(columns).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", lambda: spark.createDataFrame([], ISSUE), CFG.but(max_per_day=1), ticks=spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"), now=lambda: clock[0]).awaitTermination(240)
        return spark.read.parquet(f"{tmp_path}/out/decisions")

    ticks.write.parquet(f"{tmp_path}/ticks")
    spark.createDataFrame([row(1), row(2, "loud"), row(3)], columns).coalesce(1).write.parquet(f"{tmp_path}/in")
    told = run()
    assert sorted((r["arrival"], r["reason"]) for r in told.collect()) == [(1, "file"), (2, "invalid-severity"), (3, "budget-day")]
    ticks.write.mode("append").parquet(f"{tmp_path}/ticks")  # no new request
    told = run()
    assert [(r["arrival"], r["reason"]) for r in told.where("run = 1").collect()] == [(3, "file")]
    for days, reason in ((1, "duplicate-marker"), (40, "file")):
        clock[0] = days * 86_400
        spark.createDataFrame([row(1)], columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told = run()
        assert [r["reason"] for r in told.where(F.col("run") == told.agg(F.max("run")).first()[0]).collect()] == [reason]


def test_late_records_are_counted(spark, records, tmp_path):
    schema = split(records, f"{tmp_path}/in", "event_id")
    records.orderBy("event_id").limit(7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    J.late_job(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", CFG).awaitTermination(240)
    late = spark.read.parquet(f"{tmp_path}/out/late")
    assert late.where("run = 3").agg(F.sum("late")).first()[0] == 7
    query = J.write_stream(J.bucket_stream(stream(spark, schema, f"{tmp_path}/in"), CFG), f"{tmp_path}/rows", f"{tmp_path}/ck2")
    query.awaitTermination(240)
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) > 0


def test_suppression_by_state_equals_the_batch_operator(spark, tmp_path):
    import random

    from auditloom.operators import alerts as A

    r = random.Random(2)
    rows = [(f"k{r.randrange(4)}", r.choice(["issue-filed", "auth"]), 30_000 * i + r.randrange(9), n) for n, i in enumerate(sorted(r.randrange(300) for _ in range(400)))]
    rows += [("k0", "auth", rows[-1][2], 900), ("k0", "issue-filed", rows[-1][2], 901)]
    alerts = spark.createDataFrame(rows, "dedup_key string, category string, at bigint, seq bigint")
    schema = split(alerts, f"{tmp_path}/in", "at")
    J.write_stream(J.suppressed_stream(stream(spark, schema, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    assert same(spark.read.parquet(f"{tmp_path}/out"), A.suppress(alerts))
