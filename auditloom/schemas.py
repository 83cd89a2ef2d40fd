"""Schemas of the contracts. Every field is nullable on reading; validators name the first bad one."""

from __future__ import annotations

#: Fields of an audit record, in the order of its contract.
AUDIT_FIELDS = ("id", "scopeId", "auditActorId", "identityKeyId", "action", "outcome", "occurredAtUtc", "resourceType", "resourceId", "correlationId", "errorCode", "stage", "httpStatus", "dependency", "componentOwner")

AUDIT_RECORD = ", ".join(f"`{f}` string" for f in AUDIT_FIELDS)
DEAD_LETTER = "epoch bigint, queue string, error_class string, line string"
LOG_LINE = "path string, from_offset bigint, to_offset bigint, line_no bigint, line string"
BATCH = "schema string, batch_id string, source_path string, line_count int, byte_range struct<`from`: bigint, `to`: bigint>, content_schema string, content string, content_checksum string, dedup_key string"
FINDING = "batch_id string, severity string, category string, evidence_line string, why string, recommended_action string"
FINDINGS_JSON = "array<struct<severity: string, category: string, evidence_line: string, why: string, recommended_action: string>>"
ALERT = "schema string, severity string, category string, summary string, evidence string, action string, source_path string, batch_id string, dedup_key string, repo string, issue_number bigint, issue_url string"
REQUEST = "schema string, kind string, fingerprint string, signal string, severity string, title string, body_md string, incident_id string, dedup_key string, repo string, devloop_enabled string"
ISSUE = "repo string, number bigint, title string, body string, state string, author string, labels array<string>, assignees array<string>, created_at string, is_pull_request boolean"
COMMENT = "repo string, number bigint, id bigint, author string, body string, created_at string"
OUTBOX = "schema string, repo string, issue_number bigint, fingerprint string, signal string, severity string, title string, incident_id string, request_dedup_key string, alert_dedup_key string, phase string"
INCIDENT = "state string, signal string, family string, scope string, rtype string, component string, fp string, open_bucket string, last_fired_tick string, quiet_count int, last_quiet_bucket string"
