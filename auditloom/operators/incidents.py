"""Incidents: a hysteresis state machine over ticks, and the requests that its transitions make.

Opening takes two firing ticks, closing takes a run of quiet buckets, and what isn't covered moves nothing. One scan moves
all incidents by an expression over struct columns (``step``); a backtest and the stream walk each fingerprint's ticks in
order and take the same steps (``next_state``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BODY_BYTES, EVIDENCE_LINES, TITLE_BYTES, Config
from ..functions import scalars as S
from ..schemas import INCIDENT
from .stability import rate_text
from .walk import walk

STATE = "struct<state: string, open_bucket: string, last_fired_tick: string, quiet_count: int, last_quiet_bucket: string, action: string>"
TTL_SECONDS, REEMIT_SECONDS = 14 * 86_400, 600


def start_state() -> Column:
    return F.struct(F.lit("none").alias("state"), F.lit("").alias("open_bucket"), F.lit("").alias("last_fired_tick"), F.lit(0).alias("quiet_count"), F.lit("").alias("last_quiet_bucket"), F.lit("").alias("action"))


def _state(state, open_bucket, fired_tick, count, quiet_bucket, action="") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    return F.struct(lit(state).alias("state"), lit(open_bucket).alias("open_bucket"), lit(fired_tick).alias("last_fired_tick"), lit(count).cast("int").alias("quiet_count"), lit(quiet_bucket).alias("last_quiet_bucket"), lit(action).alias("action"))


def step(s: Column, tick: Column, cfg: Config) -> Column:
    """The state after a tick ``(tick_id, fired, quiet_ok, latest_bucket)``, with the action it makes."""
    fired, quiet, at, bucket = tick["fired"], tick["quiet_ok"], tick["tick_id"], tick["latest_bucket"]
    state, opened, last, count, quiet_at = s["state"], s["open_bucket"], s["last_fired_tick"], s["quiet_count"], s["last_quiet_bucket"]
    same = _state(state, opened, last, count, quiet_at)
    counted = F.when(bucket != quiet_at, count + 1).otherwise(count)
    closes = counted >= cfg.quiet_windows
    return (
        F.when(state == "none", F.when(fired, _state("candidate", opened, at, count, quiet_at)).otherwise(same))
        .when(state == "candidate", F.when(~fired, _state("none", "", "", 0, "")).when(last != at, _state("open", bucket, at, count, quiet_at, "open")).otherwise(same))
        .when(state == "open", F.when(fired, _state(state, opened, at, count, quiet_at)).when(quiet, _state("recovering", opened, last, 1, bucket)).otherwise(same))
        .when(state == "recovering", F.when(fired, _state("open", opened, at, 0, "", "comment"))
              .when(quiet, _state(F.when(closes, "closed").otherwise("recovering"), opened, last, counted, F.when(bucket != quiet_at, bucket).otherwise(quiet_at), F.when(closes, "close").otherwise("")))
              .otherwise(F.when((bucket != "") & (bucket != quiet_at), _state(state, opened, last, 0, "")).otherwise(same)))
        .otherwise(F.when(fired, _state("candidate", "", at, 0, "")).otherwise(same))
    )


FIELDS = ("state", "open_bucket", "last_fired_tick", "quiet_count", "last_quiet_bucket")
NOTHING = ("none", "", "", 0, "")


def next_state(old: dict, tick: dict, quiet_windows: int) -> tuple[dict, str]:
    """One step of the machine on plain values; the same table as ``step``."""
    new, bucket = dict(old), tick["latest_bucket"]
    fired, quiet = tick["fired"], tick["quiet_ok"]
    if fired:
        new["last_fired_tick"] = tick["tick_id"]
    match old["state"], fired, quiet:
        case "none", True, _:
            new["state"] = "candidate"
        case "candidate", False, _:
            return dict(zip(FIELDS, NOTHING, strict=True)), ""
        case "candidate", True, _ if old["last_fired_tick"] != tick["tick_id"]:
            return new | {"state": "open", "open_bucket": bucket}, "open"
        case "open", False, True:
            new |= {"state": "recovering", "quiet_count": 1, "last_quiet_bucket": bucket}
        case "recovering", True, _:
            return new | {"state": "open", "quiet_count": 0, "last_quiet_bucket": ""}, "comment"
        case "recovering", False, True:
            if bucket != old["last_quiet_bucket"]:
                new |= {"quiet_count": old["quiet_count"] + 1, "last_quiet_bucket": bucket}
            if new["quiet_count"] >= quiet_windows:
                return new | {"state": "closed"}, "close"
        case "recovering", False, False if bucket and bucket != old["last_quiet_bucket"]:
            new |= {"quiet_count": 0, "last_quiet_bucket": ""}
        case "closed", True, _:
            new |= {"state": "candidate", "open_bucket": "", "quiet_count": 0, "last_quiet_bucket": ""}
    return new, ""


def timeline(ticks: DataFrame, cfg: Config) -> DataFrame:
    """Every tick's state: ``ticks(fp, seq, tick_id, fired, quiet_ok, latest_bucket)`` to rows with state and action.

    A fingerprint's ticks (one a bucket) are walked in order with one state in hand, so their number doesn't matter.
    """
    quiet_windows, reads = cfg.quiet_windows, ["tick_id", "fired", "quiet_ok", "latest_bucket"]

    def one(state, *given):
        now, action = next_state(state, dict(zip(reads, given, strict=True)), quiet_windows)
        return now, (*(now[f] for f in FIELDS), action)

    rows = ticks.select("fp", "seq", "tick_id", F.coalesce("fired", F.lit(False)).alias("fired"), F.coalesce("quiet_ok", F.lit(False)).alias("quiet_ok"), F.coalesce("latest_bucket", F.lit("")).alias("latest_bucket"))
    adds = "state string, open_bucket string, last_fired_tick string, quiet_count int, last_quiet_bucket string, action string"
    return walk(rows, ["fp"], ["seq", *reads], reads, lambda: dict(zip(FIELDS, NOTHING, strict=True)), one, adds)


def ticks_of(candidates: DataFrame, cfg: Config) -> DataFrame:
    """One tick a bucket for each fingerprint, from the rules as of each bucket."""
    return candidates.select("fp", F.col("bucket").alias("seq"), F.col("bucket").cast("string").alias("tick_id"), "fired", "quiet_ok", S.bucket_label(F.col("bucket"), cfg.bucket_seconds).alias("latest_bucket"))


def frozen(ticks: DataFrame, scans: DataFrame) -> DataFrame:
    """``ticks(signal, fp, seq, ...)`` as the scans saw them: ``scans(seq, valid)`` says whose snapshot could be read.

    A scan with a broken snapshot covers nothing: no rule for audit records fires in it, nothing is quiet, and there is no newest
    bucket, so no incident recovers. Dead letters come from a source of their own. A scan without a row is valid.
    """
    told = ticks.join(scans.select("seq", "valid"), "seq", "left")
    blind = ~F.coalesce("valid", F.lit(True)) & (F.col("signal") != S.SIGNALS[3])
    return told.withColumns({"fired": F.col("fired") & ~blind, "quiet_ok": F.col("quiet_ok") & ~blind, "latest_bucket": F.when(blind, "").otherwise(F.col("latest_bucket"))}).drop("valid")


def join_tick(fired: DataFrame, tracked: DataFrame, grid: DataFrame, latest_bucket: Column | str) -> DataFrame:
    """One scan's ticks: fired candidates and tracked incidents, in full, each with whether its component is quiet.

    ``fired(fp, signal, family, scope, rtype)``, ``tracked`` an incident table, ``grid`` the newest bucket's rows with
    ``quiet_ok``; a component without a row there, though the bucket is covered, is quiet.
    """
    both = fired.select("fp", *(F.col(c).alias(f"f_{c}") for c in ("signal", "family", "scope", "rtype")), F.lit(True).alias("_fired")).join(tracked, "fp", "full_outer")
    named = both.select("fp", *(F.coalesce(f"f_{c}", c).alias(c) for c in ("signal", "family", "scope", "rtype")), F.coalesce("_fired", F.lit(False)).alias("fired"), *(c for c in tracked.columns if c not in ("fp", "signal", "family", "scope", "rtype")))
    quiet = grid.select("family", "scope", "rtype", F.col("quiet_ok").alias("_quiet"))
    latest = latest_bucket if isinstance(latest_bucket, Column) else F.lit(latest_bucket)
    return named.join(quiet, ["family", "scope", "rtype"], "left").withColumn("quiet_ok", F.coalesce("_quiet", latest != "")).withColumn("latest_bucket", latest).drop("_quiet")


def advance(ticks: DataFrame, tick_id: str, cfg: Config, now: int, clock: Column | None = None) -> DataFrame:
    """Incidents after one scan, from ``join_tick`` rows; a candidate that no longer fires goes, a closed one stays 14 days.

    With ``updated`` (epoch of the last change) in the rows, closed incidents that are older are forgotten.
    """
    old = F.when(F.col("state").isNull(), start_state()).otherwise(F.struct("state", F.coalesce("open_bucket", F.lit("")).alias("open_bucket"), F.coalesce("last_fired_tick", F.lit("")).alias("last_fired_tick"), F.coalesce("quiet_count", F.lit(0)).alias("quiet_count"), F.coalesce("last_quiet_bucket", F.lit("")).alias("last_quiet_bucket"), F.lit("").alias("action")))
    rows = ticks.withColumn("_old", old).withColumn("_tick", F.struct(F.lit(tick_id).alias("tick_id"), "fired", "quiet_ok", "latest_bucket"))
    rows = rows.withColumn("_new", step(F.col("_old"), F.col("_tick"), cfg))
    out = rows.select("fp", "signal", "family", "scope", "rtype", F.col("_old.state").alias("from_state"), "fired", "_new.*", F.lit(now).alias("updated"))
    return out.where((F.col("state") != "none") | (F.col("from_state") != "none"))


def reemit_opens(incidents: DataFrame, now: Column) -> DataFrame:
    """Open and firing incidents whose last open request is ten minutes old or older."""
    return incidents.where((F.col("state") == "open") & F.col("fired") & (F.coalesce("last_emit", F.lit(0)) + REEMIT_SECONDS <= now))


def next_index(index: DataFrame, incidents: DataFrame) -> DataFrame:
    """Fingerprints that the next scan looks at: those before, without the ones that ended, with the ones that are there now."""
    ended = incidents.where("state in ('none', 'closed')").select("fp")
    live = incidents.where("state not in ('none', 'closed')").select("fp")
    return index.select("fp").join(ended, "fp", "left_anti").unionByName(live).distinct()


INCIDENT_COLUMNS = [c.strip().split(" ")[0] for c in INCIDENT.split(",")]

LABELS = {"recurring-failure": "recurring failure", "error-spike": "error spike", "flapping": "flapping", "pipeline-dead-letter": "dead letters"}
ADVICE = {
    "recurring-failure": "The same operation fails in several windows. Find the failing caller by action and scope in the evidence, then its configuration, dependencies or permissions.",
    "error-spike": "The newest window fails far above its history. Check what changed in it first, then quotas and dependencies.",
    "flapping": "The operation switches between success and failure. Look at timeouts, retries and single bad instances.",
    "pipeline-dead-letter": "The pipeline itself drops deliveries, and what they carried raises no alerts. Read the dead letters, mend the cause, replay them.",
}


def title(signal: Column, component: Column, fp: Column, cfg: Config) -> Column:
    """At most 200 bytes, the fingerprint always whole: only the component is cut."""
    label = F.coalesce(*(F.when(signal == k, v) for k, v in LABELS.items()), signal)
    head, tail = F.concat(F.lit(f"[{cfg.issue_label}] "), label, F.lit(": ")), F.concat(F.lit(" (fp:"), fp, F.lit(")"))
    longest = max(len(f"[{cfg.issue_label}] {v}: ") for v in LABELS.values()) + 14
    return F.concat(head, S.truncate_bytes(component, TITLE_BYTES - longest), tail)


def metrics_table(rows: Column) -> Column:
    """A table of ``(label, fails, total)`` structs."""
    line = lambda r: F.concat(F.lit("| "), r["label"], F.lit(" | "), r["fails"].cast("string"), F.lit(" | "), r["total"].cast("string"), F.lit(" | "), rate_text(r["fails"], r["total"]), F.lit(" |"))
    return F.concat(F.lit("| window | failures | total | rate |\n| --- | ---: | ---: | ---: |"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("\n"), line(r))), ""))


def detail_body(kind: Column, signal: Column, component: Column, rows: Column, lines: Column, key: Column, fp: Column, incident: Column) -> Column:
    """Body of an open or comment request, at most 16384 bytes: what happened, the numbers, up to 20 lines, advice, footer."""
    total = lambda name: F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, r: a + r[name]).cast("string")
    told = F.concat(F.when(kind == "comment", "It fires again while recovering. ").otherwise(""), F.lit("Component "), component, F.lit(": "), total("fails"), F.lit(" failures of "), total("total"), F.lit(" events in "), F.size(rows).cast("string"), F.lit(" windows."))
    shown = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, EVIDENCE_LINES), "\n")).otherwise("(no single lines for this window; see the table)")
    advice = F.coalesce(*(F.when(signal == k, v) for k, v in ADVICE.items()), F.lit(ADVICE["recurring-failure"]))
    parts = ["## What happened\n", told, "\n## Numbers\n", metrics_table(rows), "\n## Evidence\n\n```", shown, "```\n\n## What to do\n", advice, "", footer(fp, incident, key)]
    return S.truncate_bytes(F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts)), BODY_BYTES)


def close_body(count: Column, key: Column, fp: Column, incident: Column) -> Column:
    told = F.concat(F.lit("No failures in "), count.cast("string"), F.lit(" quiet windows in a row; closed by the detector. A new failure opens a new incident under the same fingerprint."))
    return S.truncate_bytes(F.concat_ws("\n", F.lit("## Recovered\n"), told, F.lit(""), footer(fp, incident, key)), BODY_BYTES)


def footer(fp: Column, incident: Column, key: Column) -> Column:
    return F.concat(F.lit("---\nfp:"), fp, F.lit(" · incident_id: "), incident, F.lit(f" · detector {S.DETECTOR} · dedup_key "), key)


def requests(transitions: DataFrame, cfg: Config) -> DataFrame:
    """Issue requests from rows with an action: ``fp, signal, family, action, open_bucket, quiet_count, epoch, rows, lines``.

    Dead letters go to the pipeline's repository, everything else to the platform's with its flag set. A comment's key
    changes with the cooldown bucket of its time.
    """
    acted = transitions.where(F.coalesce("action", F.lit("")) != "")
    incident = S.incident_id(F.col("fp"), F.col("open_bucket"))
    cool = S.bucket_of(F.col("epoch"), cfg.cooldown_hours * 3600).cast("string")
    key = F.when(F.col("action") == "comment", S.dedup_key("stability-issue/comment", F.col("fp"), F.col("open_bucket"), cool)).otherwise(S.dedup_key("stability-issue", F.col("action"), F.col("fp"), F.col("open_bucket")))
    named = acted.withColumn("incident_id", incident).withColumn("dedup_key", key)
    body = F.when(F.col("action") == "close", close_body(F.col("quiet_count"), F.col("dedup_key"), F.col("fp"), F.col("incident_id"))).otherwise(
        detail_body(F.col("action"), F.col("signal"), F.col("family"), F.col("rows"), F.col("lines"), F.col("dedup_key"), F.col("fp"), F.col("incident_id")))
    own = F.col("signal") == "pipeline-dead-letter"
    return named.select(
        F.lit("issues.issue.v1").alias("schema"), F.col("action").alias("kind"), F.col("fp").alias("fingerprint"), "signal", S.severity_of("signal").alias("severity"), title(F.col("signal"), F.col("family"), F.col("fp"), cfg).alias("title"),
        body.alias("body_md"), "incident_id", "dedup_key", F.when(own, cfg.pipeline_repo).otherwise(cfg.platform_repo).alias("repo"), F.when(own, "").otherwise("1").alias("devloop_enabled"),
    )
