"""Reports over the pipeline's own logs and tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .gates import log_failed, risk_reason, shown_suspicious

CAP = 80


# --- facts of log lines -----------------------------------------------------------------------------------------------


def _int(column: Column) -> Column:
    return F.when(column.rlike(r"^-?\d+$"), column.try_cast("bigint"))


MARKER = r"\b(ISSUE_OUTBOUND|ISSUE_FILED|ISSUE_SKIP|ISSUE_PROBE|ISSUE_BUDGET_EXCEEDED)\b"
ISSUE_LINE = "struct<action: string, kind: string, mode: string, fp: string, severity: string, signal: string, title: string, reason: string, number: bigint, url: string, ok: boolean, detail: string, used: bigint, cap: bigint>"


def issue_line(line) -> Column:
    """One flat row of an issue log line; null for any other or malformed line."""
    value = S.text(line)
    marker = F.regexp_extract(value, MARKER, 1)
    rest = F.regexp_extract(value, f"{MARKER}(.*)$", 2)
    return F.when(value.rlike(MARKER), S.let(F.struct(marker.alias("marker"), rest.alias("rest"), S.fields(rest).alias("f")), lambda x: _issue_row(x["marker"], x["rest"], x["f"])))


def _issue_row(marker: Column, rest: Column, f: Column) -> Column:
    get = lambda k: F.try_element_at(f, F.lit(k))
    is_kind, is_fp = get("kind").isin("open", "comment", "close"), get("fp").rlike("^[0-9a-f]{8}$")
    filled = lambda k: F.coalesce(get(k) != "", F.lit(False))
    number, used, cap = _int(get("number")), _int(get("used")), _int(get("cap"))
    ok = (
        F.when(marker == "ISSUE_OUTBOUND", filled("mode") & is_kind & is_fp & get("severity").isin(*S.SEVERITIES) & filled("signal") & get("title").isNotNull())
        .when(marker == "ISSUE_FILED", is_kind & is_fp & number.isNotNull() & filled("url")).when(marker == "ISSUE_SKIP", is_kind & is_fp & filled("reason"))
        .when(marker == "ISSUE_PROBE", filled("kind") & get("ok").isin("0", "1")).when(marker == "ISSUE_BUDGET_EXCEEDED", get("scope").isin("day", "open") & used.isNotNull() & cap.isNotNull())
    )
    action = F.when(marker == "ISSUE_BUDGET_EXCEEDED", "budget").otherwise(F.lower(F.substring_index(marker, "_", -1)))
    only = lambda names, c: F.when(marker.isin(*(f"ISSUE_{n}" for n in names)), c)
    row = F.struct(
        action.alias("action"), F.when(marker == "ISSUE_BUDGET_EXCEEDED", get("scope")).otherwise(get("kind")).alias("kind"), only(["OUTBOUND"], get("mode")).alias("mode"), only(["OUTBOUND", "FILED", "SKIP"], get("fp")).alias("fp"), only(["OUTBOUND"], get("severity")).alias("severity"),
        only(["OUTBOUND"], get("signal")).alias("signal"), only(["OUTBOUND"], get("title")).alias("title"), only(["SKIP"], get("reason")).alias("reason"), only(["FILED"], number).alias("number"), only(["FILED"], get("url")).alias("url"), only(["PROBE"], get("ok") == "1").alias("ok"),
        only(["PROBE"], F.trim(F.regexp_extract(rest, r"\bdetail=(.*)$", 1))).alias("detail"), only(["BUDGET_EXCEEDED"], used).alias("used"), only(["BUDGET_EXCEEDED"], cap).alias("cap"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), row)


def incident_line(line) -> Column:
    """``(fp, signal, from_state, to_state, fails, total, buckets)`` of an incident's transition; null for any other line."""
    value = S.text(line)
    return F.when(value.rlike(r"\bINCIDENT\b"), S.let(S.fields(F.regexp_extract(value, r"\bINCIDENT\b(.*)$", 1)), _incident_row))


def _incident_row(f: Column) -> Column:
    get = lambda k: F.try_element_at(f, F.lit(k))
    before, after = (F.regexp_extract(S.text(get("state")), r"^(.+?)->(.+)$", i) for i in (1, 2))
    buckets = F.regexp_extract(S.text(get("buckets")), r"^(\d+)", 1)
    ok = get("fp").rlike("^[0-9a-f]{8}$") & (get("signal") != "") & (before != "") & _int(get("fails")).isNotNull() & _int(get("total")).isNotNull() & (buckets != "")
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(get("fp").alias("fp"), get("signal").alias("signal"), before.alias("from_state"), after.alias("to_state"), _int(get("fails")).alias("fails"), _int(get("total")).alias("total"), _int(buckets).alias("buckets")))


def facts(rows: DataFrame, parse: Callable[[str], Column], line: str = "line") -> DataFrame:
    """``rows`` with ``i``, what ``parse`` reads from the line; lines without are left out. Each line is parsed once."""
    return rows.select("*", F.explode(F.filter(F.array(parse(line)), lambda i: i.isNotNull())).alias("i"))


def log_lines(logs: DataFrame) -> DataFrame:
    return logs.select("file", "service", "epoch", "mtime", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def incident_entries(logs: DataFrame) -> DataFrame:
    return facts(log_lines(logs.where("service = 'sentinel'")), incident_line).select("file", "epoch", "mtime", "line_no", "i.*")


def latest_incidents(entries: DataFrame, order: list[str]) -> DataFrame:
    """The last transition of each fingerprint by ``order``, and how many there were."""
    last = F.max_by(F.struct("signal", F.col("to_state").alias("state"), "fails", "total", "buckets", F.col("epoch").alias("last_seen")), F.struct(*order))
    return entries.groupBy("fp").agg(last.alias("l"), F.count(F.lit(1)).alias("transitions")).select("fp", "l.*", "transitions")


def issue_activity(logs: DataFrame) -> DataFrame:
    """Rows of the issue log, newest first, at most 80."""
    rows = facts(log_lines(logs.where("service = 'issues'")), issue_line)
    return rows.select("file", "epoch", "mtime", "line_no", "i.*").orderBy(F.desc("mtime"), F.desc("file"), F.desc("line_no")).limit(CAP)


def would_have_filed(actions: DataFrame) -> DataFrame:
    """What a dry run would have sent: the list that thresholds are tuned on."""
    return actions.where("action = 'outbound' and mode = 'dry-run'")


# --- tables of the report ---------------------------------------------------------------------------------------------


def pretty_actor(actor) -> Column:
    """``actor:`` and ten hex digits for a hashed actor, else the actor."""
    digits = F.regexp_extract(S.text(actor), r"(?i)hmac-sha256:([0-9a-f]{6,})", 1)
    return F.when(digits != "", F.concat(F.lit("actor:"), F.substring(digits, 1, 10))).otherwise(S.text(actor))


def shown_events(records: DataFrame) -> DataFrame:
    """Audit records as the report shows them; records without an id are left out."""
    given = lambda c, default: F.coalesce(F.nullif(F.trim(S.text(c)), F.lit("")), F.lit(default))
    reason = risk_reason("action", "outcome", trim=True)
    resource = F.substring(F.concat_ws("/", F.nullif(S.text("resourceType"), F.lit("")), F.nullif(S.text("resourceId"), F.lit(""))), 1, 120)
    return records.where(S.text("id") != "").select("id", given("occurredAtUtc", "").alias("timestamp"), F.coalesce(F.nullif(pretty_actor("auditActorId"), F.lit("")), F.lit("unknown")).alias("actor"), given("action", "unknown").alias("action"), given("outcome", "unknown").alias("outcome"), resource.alias("resource"), reason.alias("reason"), reason.isNotNull().alias("suspicious"))


def merge_events(parts: list[DataFrame], most: int = 500) -> DataFrame:
    """The union of event tables, earlier ones winning for an id, newest first."""
    ranked = [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    columns = [c for c in union.columns if c not in ("id", "_source")]
    one = union.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("_source", *columns)).alias("r")).select("id", "r.*")
    return one.orderBy(F.desc("timestamp"), F.desc("id")).limit(most)


def alert_entries(logs: DataFrame, default: str = "high") -> DataFrame:
    """One row for each alert log that tells of a sending, a duplicate or a failure; logs arrive newest first."""
    text = F.col("text")
    duplicate, failed = text.rlike("(?i)SKIP duplicate"), text.rlike("(?i)webhook-failed|missing-webhook-config")
    mode = F.when(text.rlike("(?i)mode=real"), "real").otherwise("dry-run")
    pick = lambda k: F.nullif(F.regexp_extract(text, rf"{k}=(\S+)", 1), F.lit(""))
    rows = logs.where((F.col("service") == "alerts") & (duplicate | failed | text.rlike("(?i)OUTBOUND")))
    return rows.select(
        F.col("file").alias("id"), F.col("epoch").alias("at"), F.negative(F.unix_micros("mtime")).alias("arrival"), S.loose_severity(F.coalesce(pick("severity"), F.lit(default))).alias("severity"), F.coalesce(pick("category"), F.lit("audit_alert")).alias("category"), F.coalesce(pick("dedup_key"), F.lit("unknown")).alias("dedup_key"),
        mode.alias("mode"), F.when(duplicate, "duplicate").otherwise("new").alias("status"), F.when(failed, "failed").when(mode == "dry-run", "skipped").otherwise("sent").alias("delivery"), S.summary_line("text").alias("summary"),
    )


def collapse_alerts(entries: DataFrame) -> DataFrame:
    """Alerts by key and mode: how often, the newest one's summary, status and delivery, the first seen one's severity and category."""
    newest = F.max_by(F.struct("at", "summary", "status", "delivery"), F.struct("at", F.negative("arrival")))
    first = F.min_by(F.struct("severity", "category"), "arrival")
    return entries.groupBy("dedup_key", "mode").agg(F.count(F.lit(1)).alias("n"), newest.alias("l"), first.alias("f")).select("dedup_key", "mode", "n", "l.*", "f.*")


def told_findings(logs: DataFrame) -> DataFrame:
    """One row for each analyzer log that tells of findings or alerts."""
    text = F.col("text")
    number = lambda k: F.coalesce(_int(F.nullif(F.regexp_extract(text, rf"{k}=(\d+)", 1), F.lit(""))), F.lit(0))
    rows = logs.where("service = 'analyzer'").withColumn("n", number("findings")).withColumn("alerts", number("alerts")).where("n > 0 or alerts > 0")
    batch = F.coalesce(F.nullif(F.regexp_extract(text, r"batch=(\S+)", 1), F.lit("")), "file")
    told = F.concat(F.coalesce(F.nullif("n", F.lit(0)), "alerts"), F.lit(" findings, "), "alerts", F.lit(" alerts"))
    return rows.select(F.concat(F.lit("finding-"), "file").alias("id"), batch.alias("batch_id"), F.when(F.col("alerts") > 0, "high").otherwise("medium").alias("severity"), F.lit("analysis").alias("category"), told.alias("summary"), text.rlike("(?i)cached_result=true").alias("cached"), F.col("epoch").alias("at"))


def finding_logs(logs: DataFrame, fresh_results: DataFrame | None = None) -> DataFrame:
    """Findings that analyzer logs tell of, and one for the batches that were dropped and not recovered since; the newest 80."""
    dead = unresolved(dead_letter_batches(logs.where("service = 'analyzer'")), fresh_results).agg(F.count(F.lit(1)).alias("n"), F.max_by("why", "epoch").alias("why"), F.max("epoch").alias("at")).where("n > 0")
    health = dead.select(F.lit("finding-pipeline-health").alias("id"), F.lit("pipeline-health").alias("batch_id"), F.lit("high").alias("severity"), F.lit("pipeline_health").alias("category"), F.concat("n", F.lit(" batches were dropped: "), F.coalesce("why", F.lit(""))).alias("summary"), F.lit(False).alias("cached"), "at")
    return told_findings(logs).unionByName(health).orderBy(F.desc("at"), "id").limit(CAP)


def dead_letter_batches(logs: DataFrame) -> DataFrame:
    """``(file, epoch, why, batch_id)`` of dead letters; the batch is decoded from the delivery, ``_2f_`` being a slash."""
    text = F.col("text")
    encoded = F.regexp_extract(text, r"\bDELIVERY=\S*?/dedup/(\S+)", 1)
    decoded = F.array_join(F.transform(F.regexp_extract_all(encoded, F.lit(r"(_[0-9A-Fa-f]{2}_|.)"), F.lit(1)), lambda x: F.when(x.rlike("^_[0-9A-Fa-f]{2}_$"), F.decode(F.unhex(F.substring(x, 2, 2)), "iso-8859-1")).otherwise(x)), "")
    batch = F.regexp_extract(decoded, r"^audit-batch/([A-Za-z0-9._-]+)$", 1)
    return logs.where(text.rlike("DEAD_LETTER|dead_letter") & text.contains("WHY=")).select("file", "epoch", F.substring(F.regexp_extract(text, r"WHY=([^\n]*)", 1), 1, 200).alias("why"), F.nullif(batch, F.lit("")).alias("batch_id"))


def unresolved(dead: DataFrame, fresh_results: DataFrame | None) -> DataFrame:
    """Dead letters whose batch has no fresh result."""
    return dead if fresh_results is None else dead.join(fresh_results.select("batch_id"), "batch_id", "left_anti")


def poll_stats(logs: DataFrame) -> DataFrame:
    """The newest poll's numbers of records, seen and batches."""
    pattern = r"audit-poll(?:\s+mode=\S+)?\s+records=(\d+)\s+seen=(\d+)\s+batches=(\d+)"
    rows = logs.where((F.col("service") == "watcher") & F.col("text").rlike(pattern)).select("epoch", *(F.regexp_extract("text", pattern, i).cast("bigint").alias(n) for i, n in ((1, "records"), (2, "seen"), (3, "batches"))))
    return rows.orderBy(F.desc("epoch"), F.desc("records"), F.desc("seen"), F.desc("batches")).limit(1)


def service_health(logs: DataFrame) -> DataFrame:
    """The newest log of each service decides its status; the pipeline is in danger if any has failed."""
    rows = logs.where("service is not null").withColumn("failed", log_failed("file", "text")).withColumn("summary", S.summary_line("text"))
    newest = F.max_by(F.struct("failed", "summary", "epoch"), F.struct("mtime", "file"))
    return rows.groupBy("service").agg(newest.alias("l"), F.count(F.lit(1)).alias("logs"), F.count_if("failed").alias("failed_logs")).select("service", F.when(F.col("l.failed"), "danger").otherwise("ok").alias("status"), F.col("l.summary").alias("summary"), F.col("l.epoch").alias("last_seen"), "logs", "failed_logs")


def facets(events: DataFrame) -> DataFrame:
    """All, suspicious and normal events, in one pass."""
    return events.agg(F.count(F.lit(1)).alias("all_events"), F.count_if("suspicious").alias("suspect"), F.count_if(~F.col("suspicious")).alias("normal"), F.max("timestamp").alias("newest"))


def severity_counts(findings: DataFrame, alerts: DataFrame) -> DataFrame:
    high = F.col("severity").isin("high", "critical")
    return findings.agg(F.count_if(high).alias("high_findings")).crossJoin(alerts.agg(F.count_if(high & (F.col("mode") == "real")).alias("real_alerts")))


#: Categories that tell of the pipeline itself.
META = ("issue-filed", "pipeline-dead-letter", "issue-budget")


def top_attention(health: DataFrame, alerts: DataFrame) -> DataFrame:
    """The one thing to look at: a service in danger, else the newest real high or critical alert that isn't about the pipeline; or nothing."""
    danger = health.where("status = 'danger'").select(F.lit(0).alias("rank"), F.lit("service").alias("what"), F.col("service").alias("subject"), "summary", F.col("last_seen").alias("at"))
    real = alerts.where(F.col("severity").isin("high", "critical") & (F.col("mode") == "real") & ~F.col("category").isin(*META)).select(F.lit(1).alias("rank"), F.lit("alert").alias("what"), F.col("dedup_key").alias("subject"), "summary", "at")
    return danger.unionByName(real).orderBy("rank", F.desc("at"), "subject").limit(1).drop("rank")


def poll_summary(records: DataFrame, seen: DataFrame, exhausted: bool) -> DataFrame:
    """Counts of one poll: records, those seen before, those left."""
    marked = records.join(seen.select("id", F.lit(True).alias("_seen")), "id", "left")
    return marked.agg(F.count(F.lit(1)).alias("records"), F.count_if("_seen").alias("seen"), F.count_if(F.col("_seen").isNull()).alias("new"), F.max(F.nullif("occurredAtUtc", F.lit(""))).alias("newest")).withColumn("exhausted", F.lit(exhausted))


def shown_words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("suspicious", shown_suspicious("line"))
