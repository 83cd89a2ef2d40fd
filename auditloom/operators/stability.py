"""Stability signals: buckets by component, coverage, a dense calendar, and four rules as window functions.

Rules are evaluated as of every covered bucket at once; the newest bucket's rows are what a scan sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVIDENCE_LINES, Config
from ..functions import scalars as S
from ..sources.adapter import evidence_line
from ..sources.staging import staged
from .gates import is_attempt, is_failure

GROUP = ["family", "scope", "rtype"]


def stability_events(records: DataFrame, cfg: Config, line: bool = False) -> DataFrame:
    """Dated records as events ``(family, scope, rtype, bucket, epoch, failed, attempt[, line])``; attempts stay marked."""
    dated = records.withColumn("epoch", S.epoch_of("occurredAtUtc")).where("epoch is not null")
    return dated.select(
        S.action_family("action").alias("family"), S.text("scopeId").alias("scope"), S.text("resourceType").alias("rtype"), S.bucket_of(F.col("epoch"), cfg.bucket_seconds).alias("bucket"), "epoch",
        is_failure("action", "outcome").alias("failed"), (is_attempt("action") | (S.text("action") == "")).alias("attempt"), *([evidence_line(cfg).alias("line")] if line else []),
    )


def component_buckets(events: DataFrame) -> DataFrame:
    """Failures and totals by group and bucket, attempts left out."""
    return events.where("not attempt").groupBy(*GROUP, "bucket").agg(F.count_if("failed").alias("fails"), F.count(F.lit(1)).alias("total"))


def coverage(events: DataFrame) -> DataFrame:
    """One row ``(clock, covered_first, covered_last)``: what all dated records cover, attempts included."""
    return events.agg(F.max("epoch").alias("clock"), F.min("bucket").alias("covered_first"), F.max("bucket").alias("covered_last"))


def calendar(buckets: DataFrame, covered: DataFrame) -> DataFrame:
    """Every group with every covered bucket, 0 of 0 where nothing happened. Each group makes its own row of buckets."""
    groups = buckets.select(*GROUP).distinct()
    grid = groups.crossJoin(F.broadcast(covered)).where("covered_first is not null").select(*GROUP, "covered_first", "covered_last", F.explode(F.sequence("covered_first", "covered_last")).alias("bucket"))
    return grid.join(buckets, [*GROUP, "bucket"], "left").fillna(0, ["fails", "total"])


def _window(rows: int) -> Window:
    return Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(-(rows - 1), 0)


def rate_text(fails: Column, total: Column) -> Column:
    """Percent with one digit, ties to even: of the ties that a double can hold, only those at .25 would go up."""
    percent = fails / total * 100
    return F.when(total > 0, F.format_string("%.1f%%", percent - F.when(F.pmod(percent, F.lit(1.0)) == 0.25, 0.01).otherwise(0.0))).otherwise("-")


def group_summary(grid: DataFrame, cfg: Config) -> DataFrame:
    """The grid with totals over the lookback as of each bucket, and the bucket's rate as text."""
    w = _window(cfg.lookback_buckets)
    return grid.select("*", rate_text(F.col("fails"), F.col("total")).alias("rate"), F.sum("fails").over(w).alias("sum_fails"), F.sum("total").over(w).alias("sum_total"), F.count(F.lit(1)).over(w).alias("buckets"))


def recurring(grid: DataFrame, cfg: Config) -> DataFrame:
    """Failures in several buckets of the lookback, and enough of them; a burst in one bucket never fires."""
    w = _window(cfg.lookback_buckets)
    counted = grid.withColumn("fail_buckets", F.count_if(F.col("fails") > 0).over(w)).withColumn("sum_fails", F.sum("fails").over(w))
    return counted.withColumn("fired", (F.col("fail_buckets") >= cfg.recur_buckets) & (F.col("sum_fails") >= cfg.min_failures))


def error_spike(grid: DataFrame, cfg: Config) -> DataFrame:
    """A bucket above both floors whose rate stands out against the mean of earlier busy buckets of the lookback."""
    before = Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(-(cfg.lookback_buckets - 1), -1)
    prior = F.avg(F.when(F.col("total") >= cfg.prior_min_total, F.col("fails") / F.col("total"))).over(before) if cfg.lookback_buckets > 1 else F.lit(None).cast("double")
    rated = grid.withColumn("prior", F.round(prior, 9)).withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("fails") / F.col("total"), 9)))
    floors = (F.col("total") >= cfg.spike_min_total) & (F.col("fails") >= cfg.spike_min_fails)
    bar = F.round(F.greatest(F.col("prior") * cfg.spike_factor, F.col("prior") + cfg.spike_delta), 9)
    return rated.withColumn("fired", floors & (F.col("prior").isNull() | (F.col("rate") >= bar)))


def second_runs(events: DataFrame) -> DataFrame:
    """The events of each second of a component: ``(family, scope, rtype, bucket, attempt, epoch, fails, total, inside, first, last)``.

    Inside counts changes between failure and success by line, first and last are the outcomes at its ends. Lines decide the order
    only where a second has both outcomes, so only such seconds' events are dealt with their lines.
    """
    keys = [*GROUP, "bucket", "attempt", "epoch"]
    seconds = events.groupBy(*keys).agg(F.count_if("failed").alias("fails"), F.count(F.lit(1)).alias("total"))
    mixed = events.join(seconds.where("fails > 0 and fails < total").select(*keys), keys, "left_semi")
    told = mixed.withColumn("_was", F.lag("failed").over(Window.partitionBy(*keys).orderBy("line")))
    told = told.groupBy(*keys).agg(F.count_if(F.col("_was") != F.col("failed")).alias("_inside"), F.min_by("failed", "line").alias("_first"), F.max_by("failed", "line").alias("_last"))
    joined = seconds.join(told, keys, "left")
    return joined.select(*keys, "fails", "total", F.coalesce("_inside", F.lit(0)).alias("inside"), *(F.coalesce(f"_{c}", F.col("fails") > 0).alias(c) for c in ("first", "last")))


def bucket_counts(events: DataFrame) -> DataFrame:
    """Everything the rules need of a component's bucket, from ``events`` with lines.

    ``(family, scope, rtype, bucket, attempt, fails, total, inside, first, last)``: inside counts changes between failure and
    success by time and line, first and last are the outcomes at the bucket's ends. Attempts are rows of their own, for
    coverage. Events are counted by second first: a busy component's bucket has no more rows to put in order than it has seconds.
    """
    keys = [*GROUP, "bucket", "attempt"]
    told = second_runs(events).withColumn("_was", F.lag("last").over(Window.partitionBy(*keys).orderBy("epoch")))
    return told.groupBy(*keys).agg(
        F.sum("fails").alias("fails"), F.sum("total").alias("total"), (F.sum("inside") + F.count_if(F.col("_was") != F.col("first"))).alias("inside"),
        F.min_by("first", "epoch").alias("first"), F.max_by("last", "epoch").alias("last"),
    )


def with_flapping(grid: DataFrame, cfg: Config) -> DataFrame:
    """The grid (with ``inside``, ``first`` and ``last``) with ``changes``, ``flap_fails`` and ``flap_ok`` over the last buckets.

    The first event of a range has no predecessor. A bucket's first event may differ from the last one of the bucket
    before it that has events: that change is kept with the distance, and counts for ranges that reach back so far.
    """
    before = Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    was, at = F.last("last", True).over(before), F.last(F.when(F.col("total") > 0, F.col("bucket")), True).over(before)
    rows = grid.withColumn("gap", F.when(was != F.col("first"), F.col("bucket") - at))
    w = _window(cfg.flap_buckets)
    # a change across buckets counts if its predecessor's bucket is in the range as well
    crossing = F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("bucket", "gap"))).over(w)
    start = F.col("bucket") - F.lit(cfg.flap_buckets - 1)
    changes = F.sum(F.coalesce("inside", F.lit(0))).over(w) + F.size(F.filter(crossing, lambda x: x["bucket"] - x["gap"] >= start))
    return rows.select(*grid.columns, changes.alias("changes"), F.sum("fails").over(w).alias("flap_fails"), F.sum(F.col("total") - F.col("fails")).over(w).alias("flap_ok"))


def _flaps(cfg: Config) -> Column:
    return (F.col("changes") >= cfg.flap_transitions) & (F.col("flap_fails") >= cfg.flap_min_each) & (F.col("flap_ok") >= cfg.flap_min_each)


def flapping(counts: DataFrame, cfg: Config) -> DataFrame:
    """Changes between failure and success over the last buckets, as of each bucket, from ``bucket_counts``."""
    rows = with_flapping(dense(counts), cfg)
    return rows.select(*GROUP, "bucket", "fails", "total", "changes", F.col("flap_fails").alias("sum_fails"), F.col("flap_ok").alias("sum_ok"), _flaps(cfg).alias("fired"))


def dense(counts: DataFrame) -> DataFrame:
    """``bucket_counts`` on the calendar of all covered buckets, attempts gone."""
    return calendar(counts.where("not attempt").drop("attempt"), counts.agg(F.min("bucket").alias("covered_first"), F.max("bucket").alias("covered_last"))).drop("covered_first", "covered_last")


def dead_letter_bursts(letters: DataFrame, scan_epoch: int, cfg: Config) -> DataFrame:
    """Dead letters by queue and class in the window that ends at the scan, both ends included."""
    inside = F.col("epoch").between(scan_epoch - cfg.dlq_window_minutes * 60, scan_epoch)
    counts = letters.groupBy("queue", "error_class").agg(F.count_if(inside).alias("letters"), F.count(F.lit(1)).alias("all_letters"))
    return counts.withColumn("fired", F.col("letters") >= cfg.dlq_threshold)


def dead_letter_summary(letters: DataFrame, scan_epoch: int, cfg: Config) -> DataFrame:
    """Counts by bucket of the scan's window, empty buckets included."""
    start = scan_epoch - cfg.dlq_window_minutes * 60
    size = cfg.bucket_seconds
    counts = letters.where(F.col("epoch").between(start, scan_epoch)).groupBy("queue", "error_class", S.bucket_of(F.col("epoch"), size).alias("bucket")).agg(F.count(F.lit(1)).alias("fails"))
    grid = letters.select("queue", "error_class").distinct().select("*", F.explode(F.sequence(F.lit(start // size).cast("bigint"), F.lit(scan_epoch // size).cast("bigint"))).alias("bucket"))
    rows = grid.join(counts, ["queue", "error_class", "bucket"], "left").fillna(0, ["fails"])
    return rows.select("queue", "error_class", "bucket", S.bucket_label(F.col("bucket"), size).alias("label"), "fails", F.col("fails").alias("total"), F.when(F.col("fails") > 0, "100.0%").otherwise("-").alias("rate"))


def quiet(grid: DataFrame) -> DataFrame:
    """The grid with ``quiet_ok``: a covered bucket without failures. Buckets that aren't covered have no row, so are never quiet."""
    return grid.withColumn("quiet_ok", F.col("fails") == 0)


def evidence(events: DataFrame, cfg: Config, newest: int = EVIDENCE_LINES) -> DataFrame:
    """The newest lines of each group's lookback, with their place from the oldest (1, 2, ...)."""
    last = events.agg(F.max("bucket").alias("_last"))
    recent = events.crossJoin(F.broadcast(last)).where((F.col("bucket") > F.col("_last") - cfg.lookback_buckets) & ~F.col("attempt"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("epoch"), F.desc("line")))
    kept = recent.withColumn("_rank", rank).where(F.col("_rank") <= newest)
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("_rank")))
    return kept.select(*GROUP, place.cast("bigint").alias("place"), "epoch", "failed", "line")


def dead_letter_windows(letters: DataFrame, cfg: Config, last: Column | None = None, degraded: bool = False) -> DataFrame:
    """Dead letters as of the end of each bucket: ``(family, scope, rtype, bucket, fired, quiet_ok, all_fails, all_total, buckets)``.

    A scan at a bucket's last second counts the letters of the window that ends there, both ends included: each letter is
    counted for the buckets whose scan still sees it. Quiet is a bucket without letters, and never so if their source is
    ``degraded``. Buckets go from the first letter's to ``last``, or to the last letter's.
    """
    size, window = cfg.bucket_seconds, cfg.dlq_window_minutes * 60
    seen = letters.select(F.col("queue").alias("family"), F.col("error_class").alias("scope"), S.bucket_of(F.col("epoch"), size).alias("own"), (S.bucket_of(F.col("epoch") + window + 1, size) - 1).alias("until"))
    seen = seen.groupBy("family", "scope", "own", "until").agg(F.count(F.lit(1)).alias("n"))
    counted = seen.where("until >= own").select("family", "scope", F.explode(F.sequence("own", "until")).alias("bucket"), "n", "own").groupBy("family", "scope", "bucket").agg(F.sum("n").alias("all_fails"), F.sum(F.when(F.col("own") == F.col("bucket"), F.col("n")).otherwise(0)).alias("fails"))
    covered = seen.agg(F.min("own").alias("covered_first"), F.max("own").alias("covered_last"))
    if last is not None:
        covered = covered.withColumn("covered_last", F.greatest("covered_last", last))
    groups = seen.select("family", "scope").distinct().crossJoin(F.broadcast(covered)).select("family", "scope", F.explode(F.sequence("covered_first", "covered_last")).alias("bucket"))
    rows = groups.join(counted, ["family", "scope", "bucket"], "left").fillna(0, ["all_fails", "fails"])
    first = S.bucket_of((F.col("bucket") + 1) * size - 1 - window, size)
    return rows.select("family", "scope", F.lit("framework-log").alias("rtype"), "bucket", (F.col("all_fails") >= cfg.dlq_threshold).alias("fired"), ((F.col("fails") == 0) & F.lit(not degraded)).alias("quiet_ok"), "all_fails", F.col("all_fails").alias("all_total"), (F.col("bucket") - first + 1).alias("buckets"))


def rules(counts: DataFrame, cfg: Config) -> DataFrame:
    """The three rules for audit records as of every bucket, from ``bucket_counts``: one row for each signal.

    All windows share one partitioning and order, so the counts are dealt and sorted once.
    """
    grid = with_flapping(error_spike(recurring(dense(counts), cfg).withColumnRenamed("fired", "recurs"), cfg).withColumnRenamed("fired", "spikes"), cfg)
    w = _window(cfg.lookback_buckets)
    summed = grid.select(*GROUP, "bucket", "fails", "recurs", "spikes", _flaps(cfg).alias("flaps"), F.sum("fails").over(w).alias("all_fails"), F.sum("total").over(w).alias("all_total"), F.count(F.lit(1)).over(w).alias("buckets"))
    told = F.explode(F.array(*(F.struct(F.lit(signal).alias("signal"), F.col(c).alias("fired")) for signal, c in zip(S.SIGNALS, ("recurs", "spikes", "flaps"), strict=False))))
    return summed.select(*GROUP, "bucket", "fails", "all_fails", "all_total", "buckets", told.alias("t")).select("t.signal", *GROUP, "bucket", "t.fired", (F.col("fails") == 0).alias("quiet_ok"), "all_fails", "all_total", "buckets")


def candidates(records: DataFrame, cfg: Config, letters: DataFrame | None = None, degraded: bool = False) -> DataFrame:
    """Every rule as of every bucket: ``(signal, family, scope, rtype, bucket, fp, fired, quiet_ok, all_fails, all_total, buckets)``.

    Records are read once and dead letters ``(epoch, queue, error_class)`` once: the counts by bucket, which are far fewer,
    are written, and all rules start from them.
    """
    counts = staged(bucket_counts(stability_events(records, cfg, line=True)), "bucket-counts")
    told = rules(counts, cfg)
    if letters is not None:
        end = counts.agg(F.max("bucket")).first()[0]
        told = told.unionByName(dead_letter_windows(letters, cfg, F.lit(end) if end is not None else None, degraded).withColumn("signal", F.lit(S.SIGNALS[3])))
    keys = told.select("signal", *GROUP).distinct()
    named = keys.withColumn("fp", S.fingerprint(F.col("signal"), F.col("family"), F.col("scope"), F.col("rtype")))
    return told.join(named, ["signal", *GROUP])


def candidate_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(S.group_key("family", "scope", "rtype"), "signal")
