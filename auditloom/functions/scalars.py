"""Scalar functions as built-in column expressions: checksums, truncation, times, keys, labels, log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BODY_BYTES, LINE_BYTES

#: Suffixes of a failed action, outcomes that count as normal.
FAILURE_SUFFIX = r"\.(failed|rejected|denied|error|cancelled)$"
NORMAL_OUTCOMES = ("accepted", "success", "succeeded")
SIGNALS = ("recurring-failure", "error-spike", "flapping", "pipeline-dead-letter")
SEVERITIES = ("low", "medium", "high", "critical")
DETECTOR = "stability-v1"


def text(column) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- checksums -------------------------------------------------------------------------------------------------------


def _bytes(column: Column) -> Column:
    """UTF-8 bytes as an array of numbers."""
    data = F.encode(column, "utf-8")
    return F.when(F.octet_length(data) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint")))


def djb2(column) -> Column:
    """The djb2 checksum over UTF-8 bytes, as a number below 2^32."""
    return F.aggregate(_bytes(text(column)), F.lit(5381).cast("bigint"), lambda h, b: F.pmod(h * 33 + b, F.lit(1 << 32)))


def djb2_hex(column) -> Column:
    return F.lpad(F.lower(F.hex(djb2(column))), 8, "0")


def sha_hex(column, length: int = 64) -> Column:
    """The first ``length`` hex digits of SHA-256 (even, 16 to 64 for keys)."""
    return F.substring(F.sha2(text(column), 256), 1, length)


def sha_number(column) -> Column:
    """The number of the first twelve hex digits of SHA-256."""
    return F.conv(sha_hex(column, 12), 16, 10).cast("bigint")


def fnv_decimal(column) -> Column:
    """Ten digits of the multiplicative checksum modulo 4294967291 over UTF-8 bytes."""
    h = F.aggregate(_bytes(text(column)), F.lit(2166136261).cast("bigint"), lambda a, b: F.pmod(a * 16777619 + b, F.lit(4294967291)))
    return F.lpad(h.cast("string"), 10, "0")


def bounded_key(column, limit: int = 512) -> Column:
    """A key of at most ``limit`` bytes: a longer one is cut and ends in its checksum."""
    key = text(column)
    return F.when(F.octet_length(key) <= limit, key).otherwise(F.concat(truncate_bytes(key, limit - 11), F.lit("-"), fnv_decimal(key)))


# --- lengths and keys ------------------------------------------------------------------------------------------------


def truncate_bytes(column, limit: int = LINE_BYTES) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters."""
    # the cut may leave up to three bytes of a character behind: the longest of four cuts that is valid text
    cut = lambda v, back: F.try_validate_utf8(F.substring(F.encode(v, "utf-8"), 1, max(0, limit - back)).cast("string"))
    return let(text(column), lambda v: F.when(F.octet_length(v) <= limit, v).otherwise(F.coalesce(*(cut(v, k) for k in range(4)), F.lit(""))))


def truncate_marked(column, limit: int = BODY_BYTES) -> Column:
    """Cut at ``limit`` bytes and marked with an ellipsis, for closing comments."""
    return let(text(column), lambda v: F.when(F.octet_length(v) <= limit, v).otherwise(F.concat(truncate_bytes(v, limit), F.lit("…"))))


def key_segment(column, limit: int = 120, keep: str = "head") -> Column:
    """Letters, digits and ``._-`` only; dots alone get a leading underscore; ``keep`` says which end stays."""
    clean = F.regexp_replace(text(column), "[^A-Za-z0-9._-]", "_")
    clean = F.when(clean.rlike(r"^\.*$"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.substring(clean, 1, limit) if keep == "head" else F.when(F.length(clean) > limit, F.right(clean, F.lit(limit))).otherwise(clean)


def rotation_fingerprint(content: Column, size: Column) -> Column:
    """Identifies a file by the digest of its first ``size`` bytes, so that appended content still matches."""
    return F.concat_ws(":", F.lit("v2"), size.cast("string"), F.sha2(F.substring(content, F.lit(1), size.cast("int")), 256))


def percent_encode(column) -> Column:
    """RFC 3986: everything but letters, digits and ``-._~`` as ``%XX``."""
    out = F.url_encode(text(column))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_decode(column) -> Column:
    """The decoded value, or null unless encoding it again gives the same text."""
    value = F.try_url_decode(F.replace(text(column), F.lit("+"), F.lit("%2B")))
    return F.when(percent_encode(value) == text(column), value)


def batch_id(path: Column, start: Column, end: Column, chunk: Column, content: Column) -> Column:
    return F.concat_ws("-", F.lit("v3"), F.concat_ws("-", key_segment(path, 80, "tail"), djb2_hex(path)), start.cast("string"), end.cast("string"), chunk.cast("string"), sha_hex(content, 16))


def dedup_key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def incident_id(fp: Column, open_bucket: Column) -> Column:
    return F.concat_ws("-", fp, open_bucket)


def stable_uuid(column) -> Column:
    """A UUID of version 8 from SHA-256, the same for the same text."""
    h = sha_hex(column, 32)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_signature(title, body) -> Column:
    """Changes when a title or body does, and not with a time of update."""
    return djb2(F.concat(text(title), F.lit("\x1f"), text(body))).cast("string")


# --- time ------------------------------------------------------------------------------------------------------------


def epoch_of(column, honour_offset: bool = False) -> Column:
    """Seconds of an ISO-8601 time; the fraction is ignored, and so is the offset unless ``honour_offset``. Null if it is none."""
    value = text(column)
    stamp = F.try_to_timestamp(value) if honour_offset else F.try_to_timestamp(F.concat(F.substring(value, 1, 19), F.lit("Z")))
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.unix_seconds(stamp))


def bucket_of(epoch: Column, seconds: int) -> Column:
    return F.floor(epoch / F.lit(seconds)).cast("bigint")


def utc_time(epoch: Column) -> Column:
    """The UTC wall clock of an epoch, whatever the session's zone."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))


def bucket_label(bucket: Column, seconds: int) -> Column:
    """Start of a bucket as ``yyyy-MM-ddTHHmm`` in UTC, which sorts as text."""
    return F.date_format(utc_time(bucket * seconds), "yyyy-MM-dd'T'HHmm")


def valid_bucket_label(column) -> Column:
    value = text(column)
    return value.rlike(r"^\d{4}-\d\d-\d\dT\d{4}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HHmm")).isNotNull() & (F.substring(value, 1, 4) >= "1970")


def utc_date(epoch: Column) -> Column:
    return F.date_format(utc_time(epoch), "yyyy-MM-dd")


# --- actions, signals, severities -------------------------------------------------------------------------------------


def action_family(column) -> Column:
    """The lower-cased action without its one failure suffix."""
    return F.regexp_replace(F.lower(text(column)), FAILURE_SUFFIX, "")


def group_key(family, scope, rtype) -> Column:
    return F.concat_ws("|", text(family), text(scope), text(rtype))


def fingerprint(signal, family, scope, rtype) -> Column:
    """Eight hex digits that identify one signal of one component, for this revision of the rules."""
    return djb2_hex(F.concat_ws("|", F.lit(DETECTOR), text(signal), text(family), text(scope), text(rtype)))


def severity_of(signal) -> Column:
    return F.when(text(signal).isin("recurring-failure", "error-spike", "pipeline-dead-letter"), "high").otherwise("medium")


def severity_rank(column) -> Column:
    """4 for critical down to 1 for low; null for any other word."""
    value = F.lower(text(column))
    return F.when(value == "critical", 4).when(value == "high", 3).when(value == "medium", 2).when(value == "low", 1)


def loose_severity(column) -> Column:
    """A severity from a text that names one somewhere: warnings are medium, anything else is low."""
    value = F.lower(text(column))
    return F.when(value.contains("critical"), "critical").when(value.contains("high"), "high").when(value.rlike("medium|warn"), "medium").otherwise("low")


def issue_number(url) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text(url), r"^https://[^/\s]+/[^/\s]+/[^/\s]+/issues/(\d+)/?$", 1), F.lit("")), F.lit("999999999999")).cast("bigint")


def is_success_status(column) -> Column:
    return text(column).rlike(r"^2\d\d$")


# --- log lines -------------------------------------------------------------------------------------------------------


def field(column, name: str) -> Column:
    """Value of ``name=value`` or ``name='value'`` in a line; null if there is none."""
    found = F.regexp_extract(text(column), rf"(?:^|\s){name}=(?:'([^']*)'|(\S+))", 0)
    return F.when(found != "", F.regexp_replace(F.regexp_replace(found, rf"^\s?{name}=", ""), "^'|'$", ""))


def pairs(column) -> Column:
    """All ``key=value`` pairs of a line, in order, as ``key=value`` texts."""
    return F.regexp_extract_all(text(column), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=('[^']*'|\S+)"), F.lit(0))


def value_of(found: Column, name: str) -> Column:
    """The last value of a key among ``pairs``; null if there is none."""
    last = F.try_element_at(F.filter(found, lambda p: p.startswith(f"{name}=")), F.lit(-1))
    return F.regexp_replace(F.substring(last, len(name) + 2, 1 << 30), "^'|'$", "")


def fields(column) -> Column:
    """All ``key=value`` pairs of a line as a map; of equal keys the last one counts."""
    key = lambda p: F.substring_index(p, "=", 1)
    entry = lambda p: F.struct(key(p).alias("key"), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), "^'|'$", "").alias("value"))
    # read from the end, the first of equal keys is the last one of the line
    return let(F.reverse(pairs(column)), lambda found: let(F.transform(found, key), lambda names: F.map_from_entries(F.reverse(F.transform(F.filter(found, lambda p, i: F.array_position(names, key(p)) == i + 1), entry)))))


def summary_line(column) -> Column:
    """The last line that tells of a failure, else the last message, else the last line; 200 characters at most."""
    lines = F.filter(F.transform(F.split(text(column), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pick = lambda pattern: F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(-1))
    message = F.regexp_replace(pick(r"(?i)\bMSG=|OUTBOUND|findings=|batches="), "^.*?MSG=", "")
    return F.substring(F.coalesce(pick("(?i)pipeline failed|WHY=|ERROR_CLASS=|webhook-failed"), message, F.try_element_at(lines, F.lit(-1)), F.lit("")), 1, 200)
