"""Closing dropped issues: every condition must hold, and the first that doesn't is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars as S
from .gates import fp_tokens, has_any_label
from .incidents import ADVICE, LABELS

SEVERITY_LABELS = tuple(f"severity:{s}" for s in S.SEVERITIES)
SIGNAL_LABELS = tuple(f"signal:{s}" for s in S.SIGNALS)
BLOCKED_RANK, MOST_ROUND = 800, 10
PREFIX = "<!-- issues:file:v1 "


def count_of(body: Column, needle: str) -> Column:
    return (F.length(body) - F.length(F.replace(body, F.lit(needle), F.lit("")))) / F.lit(len(needle))


#: A body as ``incidents.detail_body`` makes it: component, evidence, suggestion; its footer is read apart.
LEGACY = (
    r"(?s)^## What happened\n\n(?:It fires again while recovering\. )?Component ([^\n]*): \d+ failures of \d+ events in \d+ windows\.\n\n## Numbers\n\n\| window [^`]*?\n\n## Evidence\n\n"
    r"```\n(.+?)\n```\n\n## What to do\n\n([^\n]*)\n\n---\nfp:[0-9a-f]{8} · incident_id: \S+ · detector \S+ · dedup_key \S+\s*$"
)
SECTIONS = ("## What happened\n", "## Numbers\n", "## Evidence\n", "## What to do\n", "---\nfp:")


def legacy_agrees(body: Column, title: Column, signal: Column) -> Column:
    """Whether a body without marker has each section once and in order, with evidence, and says what its title says."""
    parts = F.struct(*(F.regexp_extract(body, LEGACY, i).alias(n) for i, n in ((1, "component"), (2, "evidence"), (3, "suggestion"))))
    advice = F.coalesce(*(F.when(signal == k, v) for k, v in ADVICE.items()))
    named = F.regexp_extract(title, r"^\[[^\]]+\] [^:]+: (.*) \(fp:[0-9a-f]{8}\)$", 1)
    once = F.lit(True)
    for section in SECTIONS:
        once &= count_of(body, section) == 1
    # a title may hold the beginning of a long component only
    agrees = S.let(parts, lambda p: (p["component"] != "") & p["component"].startswith(named) & (F.trim(p["evidence"]) != "") & (p["suggestion"] == advice))
    return F.coalesce(once & (named != "") & agrees, F.lit(False))


def provenance(issues: DataFrame) -> DataFrame:
    """Issues with ``p_fp, p_incident, p_dedup, p_signal`` and ``p_error``: the marker in the body, or what an old body says."""
    body = S.text("body")
    attrs = r'<!-- issues:file:v1 repo="([^"<>]+)" fingerprint="([^"<>]+)" incident="([^"<>]+)" dedup="([^"<>]+)" request_checksum="(\d+)" -->'
    pick = lambda i: F.nullif(F.regexp_extract(body, attrs, i), F.lit(""))
    named = issues.select("*", count_of(body, PREFIX).alias("_count"), *(S.percent_decode(pick(i)).alias(n) for i, n in ((1, "_repo"), (2, "_fp"), (3, "_incident"), (4, "_dedup"))), pick(5).alias("_sum"))
    marked = F.col("_count") > 0
    bucket = F.regexp_extract(S.text("_incident"), r"^[0-9a-f]{8}-(.+)$", 1)
    signal = F.coalesce(*(F.when(F.col("title").rlike(rf"^\[[^\]]+\] {label}: .*\(fp:[0-9a-f]{{8}}\)$"), k) for k, label in LABELS.items()))
    fp = F.when(marked, F.col("_fp")).otherwise(F.regexp_extract(body, r"(?m)^fp:([0-9a-f]{8}) · incident_id: ", 1))
    incident = F.when(marked, F.col("_incident")).otherwise(F.regexp_extract(body, r"(?m)^fp:[0-9a-f]{8} · incident_id: (\S+) · detector ", 1))
    dedup = F.when(marked, F.col("_dedup")).otherwise(F.regexp_extract(body, r"(?m) · dedup_key (\S+)\s*$", 1))
    legacy = legacy_agrees(body, F.col("title"), signal)
    rows = named.withColumn("p_fp", fp).withColumn("p_incident", incident).withColumn("p_dedup", dedup).withColumn("p_signal", signal)
    checksum = request_checksum_of(F.col("repo"), F.col("p_fp"), F.col("p_incident"), F.col("p_dedup"), F.col("title"))
    label = F.when(marked, bucket).otherwise(F.regexp_extract(S.text("p_incident"), r"^[0-9a-f]{8}-(.+)$", 1))
    error = (
        F.when(F.col("body").isNull(), "audit-provenance-body").when(F.col("_count") > 1, "audit-provenance-count").when(marked & F.col("_sum").isNull(), "audit-provenance-attrs").when(~marked & ~legacy, "audit-provenance-legacy")
        .when((marked & ~F.col("_repo").eqNullSafe(F.col("repo"))) | ~F.coalesce(F.col("p_fp").rlike("^[0-9a-f]{8}$"), F.lit(False)), "audit-provenance-identity")
        .when(~S.valid_bucket_label(label) | (F.col("p_incident") != F.concat_ws("-", "p_fp", label)) | (F.col("p_dedup") != F.concat_ws("/", F.lit("stability-issue/open"), "p_fp", label)), "audit-provenance-lineage")
        .when(signal.isNull() | ~F.array_contains(fp_tokens("title"), F.col("p_fp")), "audit-provenance-title").when(marked & (F.col("_sum") != checksum), "audit-provenance-checksum")
    )
    return rows.withColumn("p_error", error).drop("_count", "_repo", "_fp", "_incident", "_dedup", "_sum")


def request_checksum_of(repo, fp, incident, dedup, title) -> Column:
    """The checksum that the request's marker carries."""
    return S.djb2(F.concat_ws("\x1f", repo, fp, incident, dedup, title)).cast("string")


STATE = r'<!-- workflow:state:v1 proposal="([^"<>]+)" state="([^"<>]+)" version="([^"<>]+)" stage_rank="(\d+)" marker_order_key="([^"<>]+)" -->'
RECONCILE = r'<!-- workflow:reconcile:v1 proposal="([^"<>]+)" version="([^"<>]+)" round="(\d+)" action="([^"<>]+)" terminal_cause="([^"<>]+)" dedup="([^"<>]+)" -->'


def drop_facts(comments: DataFrame, login: str) -> DataFrame:
    """``(repo, number, d_error)``: whether the newest state among the trusted author's comments is a drop.

    A comment holds one state marker, and a drop also one reconcile marker of the same version. The greatest order key
    decides; two comments with it are ambiguous. Issues without such comments have no row.
    """
    body = S.text("body")
    get = lambda pattern, i: F.nullif(F.regexp_extract(body, pattern, i), F.lit(""))
    proposal = F.concat(F.lit("workflow/issue/"), F.col("repo"), F.lit("/"), F.col("number").cast("string"))
    ours = comments.where(F.col("author") == login).select(
        "repo", "number", "id", "created_at", count_of(body, "<!-- workflow:state:v1 ").alias("n_state"), count_of(body, "<!-- workflow:reconcile:v1 ").alias("n_drop"), get(STATE, 1).eqNullSafe(proposal).alias("s_own"), get(STATE, 2).alias("state"), get(STATE, 3).alias("version"),
        get(STATE, 4).cast("int").alias("rank"), get(STATE, 5).alias("key"), get(RECONCILE, 1).eqNullSafe(proposal).alias("r_own"), get(RECONCILE, 2).alias("r_version"), get(RECONCILE, 3).cast("int").alias("round"), get(RECONCILE, 4).alias("r_action"), get(RECONCILE, 6).alias("r_dedup"),
    )
    state_ok, drop_ok = F.col("s_own"), F.col("r_own") & (F.col("r_action") == "drop") & F.col("round").between(0, MOST_ROUND) & (F.col("r_dedup") == F.concat(F.lit("reconcile:"), F.col("r_version"))) & F.col("r_version").endswith(F.concat(F.lit("/loop/"), F.col("round")))
    bad = (
        F.when((F.col("n_state") > 1) | (F.col("n_drop") > 1), "trusted-marker-malformed").when(((F.col("n_state") == 1) & ~state_ok) | ((F.col("n_drop") == 1) & ~F.coalesce(drop_ok, F.lit(False))), "trusted-marker-invalid")
        .when((F.col("n_drop") == 1) & (F.col("n_state") == 0), "drop-state-marker-missing").when((F.col("n_state") == 1) & (S.text("created_at") == ""), "state-marker-time-missing")
        .when((F.col("n_drop") == 1) & ((F.col("state") != "blocked") | (F.col("rank") != BLOCKED_RANK)), "drop-state-invalid").when((F.col("n_drop") == 1) & (F.col("r_version") != F.concat(F.lit("consensus:"), F.col("version"))), "drop-lineage-mismatch")
    )
    rows = ours.withColumn("_bad", bad)
    top = rows.groupBy("repo", "number").agg(F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.struct("created_at", "id"))).alias("_bad"), F.max("key").alias("_key"))
    last = rows.where("key is not null").join(top, ["repo", "number"]).where(F.col("key") == F.col("_key")).groupBy("repo", "number").agg(F.count_distinct("id").alias("_ids"), F.bool_and((F.col("state") == "blocked") & (F.col("n_drop") == 1)).alias("_drop"))
    told = top.join(last, ["repo", "number"], "left")
    return told.select("repo", "number", F.coalesce("_bad", F.when(F.col("_ids") > 1, "state-marker-order-ambiguous"), F.when(~F.coalesce("_drop", F.lit(False)), "drop-not-current")).alias("d_error"))


def drop_candidates(issues: DataFrame, cfg: Config) -> DataFrame:
    """Numbers of the open issues that are looked at, each once and in order: ours, blocked, and no pull request."""
    ours = issues.where((F.upper(S.text("state")) == "OPEN") & F.array_contains("labels", cfg.issue_label) & F.array_contains("labels", cfg.managed_prefix + "blocked") & ~F.coalesce("is_pull_request", F.lit(False)))
    return ours.where("number > 0").select("repo", "number").dropDuplicates().orderBy("repo", "number")


def drop_close(issues: DataFrame, comments: DataFrame, login: str, cfg: Config) -> DataFrame:
    """``issues`` with ``reason``: why an issue may not be closed as dropped, or ``close``."""
    rows = provenance(issues).join(drop_facts(comments, login).withColumn("_told", F.lit(True)), ["repo", "number"], "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(labels, x)
    within = lambda known: F.size(F.array_intersect(labels, F.array(*map(F.lit, known))))
    managed = tuple(cfg.managed_prefix + x for x in ("enabled", "blocked", "claimed"))
    other = F.exists(labels, lambda x: x.startswith(cfg.managed_prefix) & ~x.isin(*managed))
    assignees = F.coalesce("assignees", F.array().cast("array<string>"))
    claimed = F.when(has(cfg.managed_prefix + "claimed"), F.size(assignees) == 0).otherwise((F.size(assignees) == 1) & F.array_contains(assignees, login))
    reason = (
        F.when(~F.coalesce(F.col("number") > 0, F.lit(False)), "issue-identity").when(F.upper(S.text("state")) != "OPEN", "issue-not-open").when(S.text("author") != login, "issue-author-untrusted")
        .when(~(has(cfg.issue_label) & has(managed[0]) & has(managed[1])), "required-labels").when(F.size(F.array_distinct(labels)) != F.size(labels), "duplicate-label").when(other, "conflicting-devloop-label")
        .when((within(SIGNAL_LABELS) != 1) | (within(SEVERITY_LABELS) != 1), "audit-class-labels").when(has_any_label("labels", cfg.mute_labels), "muted").when(~claimed, "issue-claim-untrusted")
        .when(F.col("p_error").isNotNull(), F.col("p_error")).when(~(has(F.concat(F.lit("signal:"), F.col("p_signal"))) & has(F.concat(F.lit("severity:"), S.severity_of("p_signal")))), "audit-provenance-label-mismatch")
        .when(F.col("_told").isNull(), "drop-not-current").when(F.col("d_error").isNotNull(), F.col("d_error")).otherwise("close")
    )
    return rows.withColumn("reason", reason).drop("_told")
