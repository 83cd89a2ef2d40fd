"""Thresholds and limits, each clamped to its range; names of labels, prefixes and roles that a site may change."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Byte limits of the contracts.
LINE_BYTES, BATCH_BYTES, TITLE_BYTES, BODY_BYTES = 2048, 8192, 200, 16384
EVIDENCE_LINES, FINDINGS = 20, 5
DAY = 86_400

#: name: (default, least, most)
RANGES = {
    "bucket_minutes": (30, 1, 1440), "lookback_buckets": (8, 1, 336), "recur_buckets": (3, 1, 336), "min_failures": (5, 1, 1_000_000),
    "spike_min_total": (10, 1, 1_000_000), "spike_min_fails": (5, 1, 1_000_000), "spike_factor": (3.0, 1.0, 100.0), "spike_delta": (0.25, 0.0, 1.0),
    "prior_min_total": (5, 1, 1_000_000), "flap_buckets": (4, 1, 336), "flap_transitions": (6, 1, 1_000_000), "flap_min_each": (3, 1, 1_000_000),
    "dlq_threshold": (3, 1, 1_000_000), "dlq_window_minutes": (60, 1, 10_080), "quiet_windows": (6, 1, 336), "cooldown_hours": (6, 1, 168),
    "max_per_day": (5, 0, 10_000), "max_open": (20, 0, 10_000), "snapshot_rows": (1000, 1, 1_000_000),
}


@dataclass(frozen=True)
class Config:
    bucket_minutes: int = 30
    lookback_buckets: int = 8
    recur_buckets: int = 3
    min_failures: int = 5
    spike_min_total: int = 10
    spike_min_fails: int = 5
    spike_factor: float = 3.0
    spike_delta: float = 0.25
    prior_min_total: int = 5
    flap_buckets: int = 4
    flap_transitions: int = 6
    flap_min_each: int = 3
    dlq_threshold: int = 3
    dlq_window_minutes: int = 60
    quiet_windows: int = 6
    cooldown_hours: int = 6
    max_per_day: int = 5
    max_open: int = 20
    snapshot_rows: int = 1000
    autoclose: bool = False
    writing: bool = True
    #: Names that a site chooses.
    event_prefix: str = "audit event"
    issue_label: str = "stability"
    managed_prefix: str = "autodev:"
    mute_labels: tuple = ("wontfix", "muted")
    platform_repo: str = "org/platform"
    pipeline_repo: str = "org/pipeline"

    @classmethod
    def of(cls, **given) -> Config:
        """A configuration whose numbers are clamped to their ranges; what isn't a number falls back to the default."""
        kept = {}
        for f in fields(cls):
            if f.name in given and f.name in RANGES:
                default, low, high = RANGES[f.name]
                try:
                    kept[f.name] = type(default)(min(max(float(given[f.name]), low), high))
                except (TypeError, ValueError):
                    kept[f.name] = default
            elif f.name in given:
                kept[f.name] = given[f.name]
        return cls(**kept)

    def but(self, **given) -> Config:
        return replace(self, **given)

    @property
    def bucket_seconds(self) -> int:
        return self.bucket_minutes * 60
