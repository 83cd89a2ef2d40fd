"""Gates: what is suspicious, what is a failure, and whether a payload keeps its contract.

Validators return a column that names the first bad field, or null; rows with a name go to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BATCH_BYTES, FINDINGS, LINE_BYTES
from ..functions import scalars as S
from ..schemas import FINDINGS_JSON
from ..sources.logs import SHOWN_SUSPICIOUS

#: What makes a lower-cased line suspicious.
SUSPICIOUS = ("denied", "failure", "failed", "invalid", "unauthorized", "refused", "privilege", "sudo", "su[", "useradd", "usermod", "passwd", "segfault", "audit", "anomal", "error")

#: Actions that are reviewed even when they succeed.
REVIEWED = (
    r"\.deleted$", r"\.retired$", r"\.revoked$", r"\.unregistered$", r"\.tombstoned$", r"\.cleared$", r"\.archived$", r"\.deactivated$", r"\.disabled$",
    r"\.rollback\.requested$", r"\.rolled[-_]back$", r"policy", r"permission", r"credential", r"secret",
    r"^identity\.binding\.", r"^identity\.external-binding\.", r"^identity\.oauth-client\.", r"^service\.binding\.", r"^service\.endpoint_catalog\.",
    r"^service\.configuration\.imported$", r"^service\.default-serving\.changed$", r"^service\.serving_set\.updated$", r"^service\.deployment\.activated$", r"^service\.revision\.published$",
    r"^script\.catalog\.revision\.promoted$", r"^script\.definition\.upserted$", r"^device\.registration\.",
    r"^scheduled\.dispatch\.configured$", r"^scheduled\.dispatch\.enabled$", r"^scheduled\.skill-runner\.enabled$", r"^scheduled\.user-agent-catalog\.shared$", r"^scheduled\.user-agent-catalog\.unshared$",
    r"^studio\.member\.reassigned$", r"^studio\.team\.entry-member\.changed$",
)


def is_suspicious(line) -> Column:
    words = "|".join(w.replace("[", r"\[") for w in SUSPICIOUS)
    return F.lower(S.text(line)).rlike(words)


def suspicious_lines(lines: DataFrame) -> DataFrame:
    """Non-empty suspicious lines, one trailing carriage return gone, cut at 2048 bytes."""
    clean = F.regexp_replace("line", r"\r$", "")
    return lines.withColumn("line", clean).where((F.col("line") != "") & is_suspicious("line")).withColumn("line", S.truncate_bytes("line"))


def risk_reason(action, outcome, trim: bool = False) -> Column:
    """Why a record is reviewed, or null. ``trim`` drops blanks first, as the report does."""
    side = (lambda c: F.trim(S.text(c))) if trim else S.text
    out, act = F.lower(side(outcome)), F.lower(side(action))
    return (
        F.when(out == "", "missing-outcome").when(~out.isin(*S.NORMAL_OUTCOMES), F.concat(F.lit("outcome:"), out)).when(act == "", "missing-action")
        .when(act.endswith(".attempted"), F.lit(None)).when(act.rlike(S.FAILURE_SUFFIX), "failure-action").when(act.rlike("|".join(REVIEWED)), "high-impact-action")
    )


def is_failure(action, outcome) -> Column:
    """Failure for the stability path: the suffix decides before the outcome, and a missing outcome is none."""
    out = F.lower(S.text(outcome))
    return F.when(F.lower(S.text(action)).rlike(S.FAILURE_SUFFIX), True).when(out == "", False).otherwise(~out.isin(*S.NORMAL_OUTCOMES))


def is_attempt(action) -> Column:
    return F.lower(S.text(action)).endswith(".attempted")


def shown_suspicious(line) -> Column:
    """The report's test, with its own words."""
    return S.text(line).rlike(SHOWN_SUSPICIOUS)


def at_least(severity, least: str = "high") -> Column:
    """Whether a severity reaches the threshold; an unknown threshold is an error."""
    if least not in S.SEVERITIES:
        raise ValueError(f"unknown severity {least!r}")
    return F.coalesce(S.severity_rank(severity) >= S.SEVERITIES.index(least) + 1, F.lit(False))


# --- contracts --------------------------------------------------------------------------------------------------------


def first_invalid(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that doesn't hold; a null condition doesn't hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in rules))


def bounded(column, limit: int) -> Column:
    size = F.octet_length(F.col(column) if isinstance(column, str) else column)
    return size.between(1, limit)


def valid_repo(column) -> Column:
    value = S.text(column)
    return bounded(column, 140) & value.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$") & ~value.rlike(r"^\.{1,2}/|/\.{1,2}$")


def valid_number(column) -> Column:
    return S.text(column).rlike(r"^[1-9]\d*$")


def batch_error() -> Column:
    """Batches of version 3 and 2 carry their content and its checksum (version 2 also the decimal one); version 1 is looked up."""
    whole = bounded("content", BATCH_BYTES)
    sha = F.col("content_checksum") == F.sha2("content", 256)
    old = sha | (F.col("content_checksum") == S.djb2("content").cast("string"))
    version = F.regexp_extract(S.text("schema"), r"^[a-z-]+\.batch\.(v[123])$", 1)
    return F.when(version == "v3", first_invalid((bounded("batch_id", 512), "invalid-batch_id"), (whole, "invalid-content"), (sha, "checksum-mismatch"))).when(
        version == "v2", first_invalid((bounded("batch_id", 512), "invalid-batch_id"), (whole, "invalid-content"), (old, "checksum-mismatch"))).when(version == "v1", F.lit(None)).otherwise("unknown-schema")


def with_content(batches: DataFrame, store: DataFrame) -> DataFrame:
    """``batches`` with content and ``error_class``; version 1 takes it from ``store(batch_id, content)``, and a miss is an error."""
    stored = store.select("batch_id", F.col("content").alias("_stored"))
    old = F.col("schema").endswith(".v1")
    both = batches.join(stored, "batch_id", "left").withColumn("content", F.when(old, F.col("_stored")).otherwise(F.col("content")))
    return both.withColumn("error_class", F.coalesce(F.when(old & F.col("_stored").isNull(), "missing-content"), batch_error())).drop("_stored")


def finding_ok(f: Column) -> Column:
    """Whether one finding keeps its contract."""
    limits = (("evidence_line", LINE_BYTES), ("why", 1000), ("recommended_action", 1000))
    ok = F.lower(f["severity"]).isin(*S.SEVERITIES) & f["category"].rlike("^[a-z0-9][a-z0-9._-]*$") & (F.octet_length(f["category"]) <= 80)
    for name, limit in limits:
        ok &= F.octet_length(f[name]).between(1, limit)
    return F.coalesce(ok, F.lit(False))


def parse_findings(outputs: DataFrame) -> DataFrame:
    """``outputs(batch_id, output)`` with ``findings`` or ``error_class``: a JSON array of at most five valid findings, or all of it is rejected."""
    trimmed = F.trim("output")
    parsed = F.from_json(trimmed, FINDINGS_JSON)
    shape = F.schema_of_variant(F.try_parse_json(trimmed))
    array = F.coalesce(trimmed.startswith("[") & shape.startswith("ARRAY<"), F.lit(False))
    rows = outputs.withColumn("_findings", F.when(array, parsed))
    error = F.when(~array | F.col("_findings").isNull(), "not-a-json-array").when(F.size("_findings") > FINDINGS, "too-many-findings").when(~F.forall("_findings", finding_ok), "invalid-finding")
    return rows.withColumn("error_class", error).withColumn("findings", F.when(F.col("error_class").isNull(), F.col("_findings"))).drop("_findings")


ALERT_LIMITS = {"category": 80, "summary": 1200, "evidence": 2048, "action": 1200, "source_path": 512, "dedup_key": 512}


def issue_address(repo: Column, number: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/issues/"), number.cast("string"))


def filed_alert_key(repo: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("issue-alert/issue-filed"), repo, number.cast("string"))


def alert_error() -> Column:
    """The first invalid field of an alert; one about a filed issue must also have its canonical key and addresses."""
    repo, number = F.col("repo"), F.col("issue_number")
    canonical = valid_repo("repo") & valid_number("issue_number") & (F.col("dedup_key") == filed_alert_key(repo, number)) & (F.col("issue_url") == issue_address(repo, number)) & (F.col("source_path") == issue_address(repo, number))
    return first_invalid(
        (F.col("schema").endswith(".alert.v1"), "unknown-schema"), (F.lower("severity").isin(*S.SEVERITIES), "invalid-severity"),
        *((bounded(name, limit), f"invalid-{name}") for name, limit in ALERT_LIMITS.items()), ((F.col("category") != "issue-filed") | F.coalesce(canonical, F.lit(False)), "invalid-issue-filed-alert"),
    )


def request_error() -> Column:
    """The first invalid field of an issue request."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return first_invalid(
        (F.col("schema").endswith(".issue.v1"), "unknown-schema"), (F.col("kind").isin("open", "comment", "close"), "invalid-kind"), (F.lower("severity").isin(*S.SEVERITIES), "invalid-severity"),
        (F.col("signal").isin(*S.SIGNALS), "invalid-signal"), (F.col("fingerprint").rlike("^[0-9a-f]{8}$"), "invalid-fingerprint"),
        (bounded("title", 200) & F.col("title").contains(F.concat(F.lit("fp:"), F.col("fingerprint"))), "invalid-title"), (bounded("body_md", 16384), "invalid-body_md"),
        (bounded("dedup_key", 512), "invalid-dedup_key"), (bounded("incident_id", 128), "invalid-incident_id"), (~given("repo") | valid_repo("repo"), "invalid-repo"),
        (~given("devloop_enabled") | (F.col("devloop_enabled") == "1"), "invalid-devloop_enabled"),
    )


def outbox_error() -> Column:
    """The first invalid part of an outbox record: a reservation has no number yet, a final one has its canonical key."""
    number, alert = S.text("issue_number"), S.text("alert_dedup_key")
    reserved = F.col("phase") == "reserved"
    return first_invalid(
        (F.col("schema").endswith(".filed-alert.v1"), "invalid-filed-alert-record"), (valid_repo("repo"), "invalid-filed-alert-repo"), (F.col("fingerprint").rlike("^[0-9a-f]{8}$"), "invalid-filed-alert-fingerprint"),
        (F.col("signal").isin(*S.SIGNALS) & F.col("severity").isin(*S.SEVERITIES), "invalid-filed-alert-classification"),
        (bounded("title", 200) & bounded("incident_id", 128) & bounded("request_dedup_key", 512), "invalid-filed-alert-identity"), (~reserved | ((number == "") & (alert == "")), "invalid-filed-alert-reservation"),
        (reserved | (F.col("phase") == "finalized"), "invalid-filed-alert-phase"), (reserved | valid_number("issue_number"), "invalid-filed-alert-number"),
        (reserved | (alert == filed_alert_key(F.col("repo"), number)), "invalid-filed-alert-dedup"),
    )


def ack_error() -> Column:
    ok = F.col("schema").endswith(".delivery-ack.v1") & (F.col("kind") == "issue-filed") & valid_repo("repo") & valid_number("issue_number") & (F.col("dedup_key") == filed_alert_key(F.col("repo"), F.col("issue_number")))
    return F.when(~F.coalesce(ok, F.lit(False)), "invalid-filed-alert-ack")


def fp_tokens(title) -> Column:
    """All fingerprints that a title names as ``fp:<hex>`` between blanks, brackets or its ends."""
    return F.regexp_extract_all(S.text(title), F.lit(r"(?<![^\s(\[])fp:([0-9a-f]{8})(?![^\s)\]])"), F.lit(1))


def names_fp(title, fp) -> Column:
    return F.array_contains(fp_tokens(title), F.col(fp) if isinstance(fp, str) else fp)


def has_any_label(labels, wanted: tuple) -> Column:
    return F.arrays_overlap(F.col(labels), F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def has_label_prefix(labels, prefix: str) -> Column:
    return F.exists(labels, lambda x: x.startswith(prefix))


def quarantine(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with ``error_class``."""
    marked = rows.withColumn("error_class", error)
    return marked.where("error_class is null").drop("error_class"), marked.where("error_class is not null")


SPANS = {"15m": 900, "1h": 3600, "6h": 21_600, "24h": 86_400}


def in_time_range(timestamp, span: str, now: Column) -> Column:
    """Whether a time lies within the span before ``now``; ``all`` and times that can't be read pass."""
    if span not in SPANS:
        return F.lit(True)
    at = S.epoch_of(timestamp)
    return at.isNull() | (at >= now - SPANS[span])


def matches_search(columns: list[str], query: str) -> Column:
    """Case-insensitive search in the joined columns; an empty query matches all."""
    return F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower())


def log_failed(file, content) -> Column:
    """Whether a runtime log tells of a failure: its last standalone exit line decides, unless it is a dead letter's."""
    value = S.text(content)
    last = F.try_element_at(F.regexp_extract_all(value, F.lit(r"(?m)^EXIT=(-?\d+)[ \t\r]*$"), F.lit(1)), F.lit(-1))
    return (
        F.when(F.col(file).contains(".dead_letter-") & value.rlike(r"(?i)\btag=DEAD_LETTER\b"), True).when(value.rlike(r"(?i)\[framework\]\s+pipeline failed:"), True)
        .when(last.isNotNull(), last != "0").otherwise(value.rlike(r"\bTIMED_OUT=true\b"))
    )


def cache_fresh(content, now_ms: Column) -> Column:
    """Whether a cached value's expiry, in nanoseconds, lies after ``now_ms``; without one it is stale."""
    at = F.regexp_extract(S.text(content), r"(?m)^[a-z]+-cache-v1 expires_at=(\d+)\s*$", 1)
    return F.coalesce(at.try_cast("decimal(38,0)") > now_ms.cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(10,0)"), F.lit(False))
