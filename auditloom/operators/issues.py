"""Issue requests: what each one comes to, budgets, provenance, recovery, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY, Config
from ..functions import scalars as S
from ..sources.staging import staged
from .gates import fp_tokens, has_any_label, has_label_prefix, request_error
from .walk import walk

DONE_TTL = 30 * DAY


def issues_by_fp(issues: DataFrame, cfg: Config) -> DataFrame:
    """Issues of ours by each fingerprint that their title names: an equality instead of a search in titles."""
    ours = issues.where(F.array_contains("labels", cfg.issue_label) & ~F.coalesce("is_pull_request", F.lit(False)))
    return ours.select("*", F.explode(F.array_distinct(fp_tokens("title"))).alias("fingerprint"))


def fp_states(issues: DataFrame, cfg: Config) -> DataFrame:
    """``(repo, fingerprint, closed_muted, open_muted, open_number, open_author, open_labels)``, one row for each."""
    rows = issues_by_fp(issues, cfg).withColumn("_muted", has_any_label("labels", cfg.mute_labels)).withColumn("_open", F.lower("state") == "open")
    live = F.col("_open") & ~F.col("_muted")
    first = lambda c: F.min_by(c, F.when(live, F.col("number")))
    return rows.groupBy("repo", "fingerprint").agg(
        F.bool_or(~F.col("_open") & F.col("_muted")).alias("closed_muted"), F.bool_or(F.col("_open") & F.col("_muted")).alias("open_muted"),
        F.min(F.when(live, F.col("number"))).alias("open_number"), first("author").alias("open_author"), first("labels").alias("open_labels"),
    )


def created_by_day(issues: DataFrame, login: str, cfg: Config) -> DataFrame:
    """Issues that we created, by repository and UTC day."""
    ours = issues.where((F.col("author") == login) & F.array_contains("labels", cfg.issue_label) & ~F.coalesce("is_pull_request", F.lit(False)))
    return ours.groupBy("repo", F.substring("created_at", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("used"))


def open_counts(issues: DataFrame, cfg: Config) -> DataFrame:
    return issues.where((F.lower("state") == "open") & F.array_contains("labels", cfg.issue_label)).groupBy("repo").agg(F.count(F.lit(1)).alias("open_used"))


def decide(requests: DataFrame, issues: DataFrame, done: DataFrame, cfg: Config, login: str = "") -> DataFrame:
    """What each request comes to: ``requests`` with ``decision`` (file, comment, close, skip, pending, error) and ``reason``.

    ``requests`` has an ``arrival`` order and a ``day``; ``done(repo, dedup_key)`` lists what was finished in 30 days. The
    first that applies wins: invalid; done before; not writing; a muted issue; an open issue adopted; no open issue to
    comment on or close; closing not allowed; recovered before it was filed; the budgets of the day and of open issues.

    Requests are served one after the other, in order of arrival: what one of them files or closes is there, or gone, for
    those that come later, and the repeat of a finished request is a duplicate. Rows that are equal in repo, key and arrival
    are one request.
    """
    rows = requests.withColumn("repo", F.when(S.text("repo") == "", cfg.platform_repo).otherwise(F.col("repo"))).withColumn("error_class", request_error())
    rows = rows.join(done.select("repo", "dedup_key", F.lit(True).alias("_done")).distinct(), ["repo", "dedup_key"], "left")
    rows = rows.join(fp_states(issues, cfg), ["repo", "fingerprint"], "left")
    # only requests that are valid and not done speak for their incident
    waiting = rows.where("error_class is null and _done is null").groupBy("repo", "incident_id").agg(F.bool_or(F.col("kind") == "open").alias("_opens"), F.bool_or(F.col("kind") == "close").alias("_closes"))
    rows = rows.join(waiting, ["repo", "incident_id"], "left").fillna(False, ["_opens", "_closes"])
    used = created_by_day(issues, login, cfg) if login else issues.limit(0).select("repo", F.lit("").alias("day"), F.lit(0).cast("bigint").alias("used"))
    rows = rows.join(used, ["repo", "day"], "left").join(open_counts(issues, cfg), "repo", "left").fillna(0, ["used", "open_used"])
    managed = (S.text("devloop_enabled") == "1") | F.coalesce(has_label_prefix("open_labels", cfg.managed_prefix), F.lit(False))
    first = F.when(F.col("error_class").isNotNull(), F.col("error_class")).when(F.col("_done"), "duplicate-marker").when(F.lit(not cfg.writing), "dry-run").when(F.col("closed_muted") | F.col("open_muted"), "muted")
    rows = staged(rows.withColumns({"_first": first, "_managed": managed, "_has": F.col("open_number").isNotNull()}), "requests")
    acts = staged(_acts(rows.where("_first is null"), cfg), "acts")

    # what the requests before have done: for the fingerprint, and for the day's budget
    me = F.struct("arrival", "dedup_key")
    by_fp = acts.groupBy("repo", "fingerprint").agg(F.array_sort(F.collect_list(F.struct("arrival", "dedup_key", "act"))).alias("_acts"))
    by_day = acts.where("act = 'file'").groupBy("repo", "day").agg(F.collect_list(me).alias("_filed"))  # max_per_day at most
    rows = rows.join(by_fp, ["repo", "fingerprint"], "left").join(by_day, ["repo", "day"], "left")
    all_acts = F.coalesce("_acts", F.array().cast("array<struct<arrival: bigint, dedup_key: string, act: string>>"))
    before = F.filter(all_acts, lambda x: F.struct(x["arrival"], x["dedup_key"]) < F.struct(F.col("arrival").cast("bigint"), "dedup_key"))
    own = F.exists(all_acts, lambda x: (x["arrival"] == F.col("arrival")) & (x["dedup_key"] == F.col("dedup_key")))
    rows = rows.withColumns({"_last": F.try_element_at(before, F.lit(-1))["act"], "_own": own}).withColumn("_now", F.coalesce(F.col("_last") == "file", F.col("_has")))
    kind, has = F.col("kind"), F.col("_now")
    untrusted = (S.text("devloop_enabled") == "1") & ~F.array_contains(F.coalesce("open_labels", F.array().cast("array<string>")), cfg.managed_prefix + "enabled") & (S.text("open_author") != login) & F.col("_last").isNull()
    spent = F.col("used") + F.size(F.filter(F.coalesce("_filed", F.array().cast("array<struct<arrival: bigint, dedup_key: string>>")), lambda x: x < F.struct(F.col("arrival").cast("bigint"), "dedup_key")))
    reason = (
        F.when(F.col("_first").isNotNull(), F.col("_first"))
        .when((kind == "open") & has, F.when(F.lit(bool(login)) & untrusted, "open-issue-adopted-untrusted-author").otherwise("open-issue-adopted"))
        .when((kind == "comment") & ~has & F.col("_last").isNull(), F.when(F.col("_opens"), "waiting-for-pending-open").otherwise("no-open-issue"))
        .when((kind == "close") & ~has, F.when(F.col("_opens") & F.col("_last").isNull(), "recovered-before-open-filed").otherwise("no-open-issue"))
        .when((kind == "close") & F.col("_managed"), "devloop-managed").when((kind == "close") & F.lit(not cfg.autoclose), "autoclose-disabled")
        .when((kind == "open") & F.col("_closes"), "recovered-before-open-filed")
        .when(kind != "open", kind).when(F.col("_own"), "file").when(spent >= cfg.max_per_day, "budget-day").otherwise("budget-open")
    )
    return _without_repeats(rows.withColumn("reason", reason)).drop("_done", "_opens", "_closes", "_first", "_managed", "_has", "_acts", "_filed", "_last", "_own", "_now", "used", "open_used", "closed_muted", "open_muted", "open_author", "open_labels")


def _acts(rows: DataFrame, cfg: Config) -> DataFrame:
    """``(repo, day, fingerprint, arrival, dedup_key, act)``: which requests file or close an issue, from those that nothing decides beforehand.

    A repository's requests are walked in order of arrival; what is held are its budgets, the fingerprints that were
    filed or closed on the way, and finished keys that come again. A request that is refused on one budget doesn't use up the other.

    Where nothing is closed, a fingerprint asks once a day, and of a day's asks so many as both budgets allow decide all: at most
    ``max_open`` of them can have been filed on another day. So a repository with very many requests has few to walk.
    """
    place = F.struct("arrival", "dedup_key")
    columns = ["repo", "day", "fingerprint", F.col("arrival").cast("bigint").alias("arrival"), "dedup_key", "kind", "_has", "_managed", "_closes", "used", "open_used"]
    if cfg.autoclose:
        asks = rows.where("kind in ('open', 'close')").select(*columns)
        again = rows.groupBy("repo", "dedup_key").agg(F.countDistinct("arrival").alias("_times")).where("_times > 1").select("repo", "dedup_key", F.lit(True).alias("_again"))
        asks = asks.join(again, ["repo", "dedup_key"], "left").fillna(False, ["_again"])
    else:
        asks = rows.where("kind = 'open' and not _has and not _closes").select(*columns)
        asks = asks.groupBy("repo", "fingerprint", "day").agg(F.min_by(F.struct(*(c for c in asks.columns if c not in ("repo", "fingerprint", "day"))), place).alias("r")).select("repo", "fingerprint", "day", "r.*").withColumn("_again", F.lit(False))
        rank = F.row_number().over(Window.partitionBy("repo", "day").orderBy("arrival", "dedup_key"))
        asks = asks.withColumn("_rank", rank).where(F.col("_rank") <= cfg.max_per_day + cfg.max_open).drop("_rank")

    def step(state, day, fp, kind, has, managed, closes, used, open_used, key, again):
        filed, there, more, finished = state  # filed by day; issues that were opened or closed on the way; open ones more than before; finished keys that repeat
        if again and key in finished:
            return state, (None,)
        act, has, ends = None, there.get(fp, has), True
        if kind == "close":
            if has and not managed:
                act, there[fp], more = "close", False, more - 1
        elif not (has or closes):
            ends = used + filed.get(day, 0) < cfg.max_per_day and open_used + more < cfg.max_open
            if ends:
                act, there[fp], more = "file", True, more + 1
                filed[day] = filed.get(day, 0) + 1
        if again and ends:
            finished.add(key)
        return (filed, there, more, finished), (act,)

    reads = ["day", "fingerprint", "kind", "_has", "_managed", "_closes", "used", "open_used", "dedup_key", "_again"]
    walked = walk(asks, ["repo"], ["arrival", "dedup_key"], reads, lambda: ({}, {}, 0, set()), step, "act string")
    return walked.where("act is not null").select("repo", "day", "fingerprint", "arrival", "dedup_key", "act")


def _decision() -> Column:
    reason = F.col("reason")
    return F.when(F.col("error_class").isNotNull(), "error").when(reason.isin("file", "comment", "close"), reason).when(reason.isin("dry-run", "waiting-for-pending-open", "budget-day", "budget-open"), "pending").otherwise("skip")


def _without_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``decision``; a request whose key was finished by an earlier one of these rows is a duplicate."""
    told = staged(rows.withColumn("decision", _decision()), "decided")
    finished = F.min(F.when(~F.col("decision").isin("pending", "error"), F.col("arrival")))
    repeated = told.groupBy("repo", "dedup_key").agg(F.countDistinct("arrival").alias("_times"), finished.alias("_finished")).where("_times > 1 and _finished is not null").drop("_times")
    told = told.join(repeated, ["repo", "dedup_key"], "left").withColumn("_again", F.coalesce(F.col("arrival") > F.col("_finished"), F.lit(False)) & F.col("error_class").isNull())
    return told.withColumn("reason", F.when(F.col("_again"), "duplicate-marker").otherwise(F.col("reason"))).withColumn("decision", _decision()).drop("_again", "_finished")


def budget_alerts(decided: DataFrame, cfg: Config) -> DataFrame:
    """One alert for each budget, repository and day that refused something."""
    refused = decided.where(F.col("reason").isin("budget-day", "budget-open")).select("repo", "day", F.substring_index("reason", "-", -1).alias("scope")).distinct()
    cap = F.when(F.col("scope") == "day", cfg.max_per_day).otherwise(cfg.max_open)
    return refused.select("*", S.dedup_key("issue-alert/budget", F.col("scope"), F.col("repo"), F.col("day")).alias("dedup_key"), cap.alias("cap"))


def reconcile_order(pending: DataFrame) -> DataFrame:
    """Closing before opening before commenting, then by arrival."""
    return pending.orderBy(F.when(F.col("kind") == "close", 0).when(F.col("kind") == "open", 1).otherwise(2), "arrival")


def next_pending(decided: DataFrame) -> DataFrame:
    """Requests that wait for the next run; an incident that was recovered before filing leaves nothing behind."""
    gone = decided.where("reason = 'recovered-before-open-filed'").select("repo", "incident_id").distinct()
    return decided.where("decision = 'pending'").join(gone, ["repo", "incident_id"], "left_anti")


def capped_distinct(rows: DataFrame, key: str, most: int = 256, keep_newest: bool = False, order: str = "arrival") -> DataFrame:
    """First row of each key; a registry keeps its newest ``most`` keys, an index with more is an error and never forgets."""
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    if keep_newest:
        return first.orderBy(F.desc(order), key).limit(most)
    if (n := first.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} keys: {n}")
    return first


# --- what is published -------------------------------------------------------------------------------------------------


def request_checksum(repo: Column, title: Column) -> Column:
    return S.djb2(F.concat_ws("\x1f", repo, S.text("fingerprint"), S.text("incident_id"), S.text("dedup_key"), title)).cast("string")


def provenance_marker(repo: Column, title: Column) -> Column:
    """A comment that names the request an issue was made for; values are percent-encoded, so none can end it."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), S.percent_encode(c), F.lit('"'))
    return F.concat(F.lit("<!-- issues:file:v1"), attribute("repo", repo), attribute("fingerprint", F.col("fingerprint")), attribute("incident", F.col("incident_id")), attribute("dedup", F.col("dedup_key")), F.lit(' request_checksum="'), request_checksum(repo, title), F.lit('" -->'))


def with_provenance(body: Column, marker: Column) -> Column:
    """The marker before the last footer, else at the end."""
    parts = F.split(body, "\n\n---\n", -1)
    n = F.size(parts)
    return F.when(n > 1, F.concat(F.array_join(F.slice(parts, 1, n - 1), "\n\n---\n"), F.lit("\n\n"), marker, F.lit("\n\n---\n"), F.element_at(parts, -1))).otherwise(F.concat(body, F.lit("\n\n"), marker))


def has_provenance(body: Column, marker: Column) -> Column:
    """Whether the marker is there exactly once."""
    return (F.length(body) - F.length(F.replace(body, marker, F.lit("")))) == F.length(marker)


def labels(cfg: Config) -> Column:
    wanted = F.array(F.lit(cfg.issue_label), F.concat(F.lit("signal:"), F.col("signal")), F.concat(F.lit("severity:"), F.lower("severity")), F.when(S.text("devloop_enabled") == "1", cfg.managed_prefix + "enabled"))
    return F.filter(wanted, lambda x: x.isNotNull())


#: Colours of severity labels.
SEVERITY_COLOURS = {"critical": "b60205", "high": "d93f0b", "medium": "fbca04", "low": "c2e0c6"}


def label_specs(requests: DataFrame, cfg: Config) -> DataFrame:
    """``(repo, name, color, description)`` of every label that the requests need, once for each repository."""
    each = requests.select("repo", F.explode(labels(cfg)).alias("name"))
    severity = F.regexp_extract("name", "^severity:(.+)$", 1)
    colour = F.coalesce(*(F.when(severity == k, v) for k, v in SEVERITY_COLOURS.items()), F.lit("ededed"))
    told = F.when(severity != "", F.concat(F.lit("severity "), severity)).when(F.col("name").startswith("signal:"), F.concat(F.lit("detected by the rule "), F.regexp_replace("name", "^signal:", ""))).otherwise("set by the stability pipeline")
    return each.distinct().select("repo", "name", colour.alias("color"), told.alias("description"))


def issue_json(cfg: Config) -> Column:
    body = with_provenance(F.col("body_md"), provenance_marker(F.col("repo"), F.col("title")))
    return F.to_json(F.struct(F.col("title"), body.alias("body"), labels(cfg).alias("labels")))


def recover_created(reserved: DataFrame, issues: DataFrame, cfg: Config, login: str) -> DataFrame:
    """Issues that were created though their number was never recorded: ``reserved`` requests with ``number`` or ``recovery``.

    The title must be equal, the marker valid, all labels there and the author ours; two such issues are ambiguous.
    """
    found = issues.select("repo", "title", F.col("number").alias("_number"), F.col("body").alias("_body"), F.col("author").alias("_author"), F.col("labels").alias("_labels"))
    rows = reserved.join(found, ["repo", "title"], "left")
    match = has_provenance(F.col("_body"), provenance_marker(F.col("repo"), F.col("title"))) & (F.size(F.array_except(labels(cfg), F.col("_labels"))) == 0)
    ours = F.coalesce(match & (F.col("_author") == login), F.lit(False))
    other = F.coalesce(match & (F.col("_author") != login), F.lit(False))
    told = rows.groupBy("repo", "dedup_key").agg(F.count_if(ours).alias("_n"), F.min(F.when(ours, F.col("_number"))).alias("number"), F.bool_or(other).alias("_other"))
    return told.select("repo", "dedup_key", F.when(F.col("_n") == 1, F.col("number")).alias("number"), F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n") == 1, "recovered").when(F.col("_other"), "provenance-author-mismatch").otherwise("none").alias("recovery"))


def changed_issues(issues: DataFrame, ledger: DataFrame, cfg: Config, now: int, ttl: int = DONE_TTL) -> DataFrame:
    """Tasks for issues whose title or body is new in 30 days; a later time of update alone is none. Ours and managed ones are left out."""
    kept = issues.where((F.col("number") > 0) & ~has_label_prefix("labels", cfg.managed_prefix) & ~F.array_contains("labels", cfg.issue_label))
    signed = kept.withColumn("signature", S.content_signature("title", "body"))
    tasks = signed.select("repo", "number", "title", "body", "signature", S.dedup_key("issue-task", F.col("repo"), F.col("number"), F.col("signature")).alias("task_id")).dropDuplicates(["task_id"])
    live = ledger.where(F.col("at") > now - ttl)
    return tasks.join(live.select("task_id"), "task_id", "left_anti")


def task_text() -> Column:
    """A task for a reader: the address, the title cut at 400 bytes, the body at 60 000."""
    return F.concat_ws("\n\n", F.concat(F.col("repo"), F.lit("#"), F.col("number")), S.truncate_bytes("title", 400), S.truncate_bytes("body", 60_000))
