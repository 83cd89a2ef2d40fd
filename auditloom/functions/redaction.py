"""Redaction of lines: one rule set for log lines that are analysed, one for texts that leave the site.

Rules are chains of ``regexp_replace``, so they stay in one projection. Both sets give the same result when applied twice.
Text is redacted line by line.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import let, text

#: What a sensitive key contains, once it is lower-cased and only letters and digits are left.
SENSITIVE = ("token", "secret", "password", "passwd", "apikey", "authorization", "cookie", "credential", "privatekey", "signature", "webhook")
#: Identity keys of log lines (whole keys), and of outbound texts (parts of keys).
IDENTITY = ("id", "actor", "auditactorid", "identity", "identitykey", "identitykeyid", "correlation", "correlationid", "scope", "scopeid", "resource", "resourceid", "userid", "tenantid", "deviceid", "requestid", "sessionid", "traceid")
SHORTENED = ("id", "actor", "identitykey", "correlation", "scope", "resource")

_KEY = "[A-Za-z0-9_.-]"
_START = f"(?<!{_KEY})"


def _needle(word: str) -> str:
    """The word, with separators anywhere inside."""
    return "[_.-]*".join(map(re.escape, word))


def sensitive_key(words=SENSITIVE, auth: str = "exact") -> str:
    """A pattern for sensitive keys: ``auth`` counts as a whole key (``exact``) or anywhere (``inside``)."""
    inside = "|".join(map(_needle, words + (("auth",) if auth == "inside" else ())))
    alone = f"|[_.-]*{_needle('auth')}[_.-]*" if auth == "exact" else ""
    return f"(?:{_KEY}*(?:{inside}){_KEY}*{alone})"


def is_sensitive_key(column, auth: str = "exact") -> Column:
    return F.regexp_replace(F.lower(text(column)), "[^a-z0-9]", "").rlike(f"^(?:.*(?:{'|'.join(SENSITIVE + (('auth',) if auth == 'inside' else ()))}).*|auth)$")


def _chain(column: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        column = F.regexp_replace(column, pattern, to)
    return column


_BLOBS = [
    (r"(?i)\bbearer\s+[^\s,;]+", "Bearer ***"),
    (r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_-]+(?![A-Za-z0-9])", "***github-token***"),
    (r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9_-]+(?![A-Za-z0-9])", "***github-token***"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "***jwt***"),
    (r"([A-Za-z][A-Za-z0-9+.-]*://)[^@/\s]+@", "$1"),
]


def _escaped(key: str) -> str:
    r"""``\"key\": \"value\"`` inside a JSON string."""
    return rf'(?<!\\)(\\"{key}\\"\s*:\s*\\")(?:(?!(?<!\\)\\").)*?((?<!\\)\\")'


#: What a line must have for the rules on blobs, and for the one on hexadecimal runs.
_BLOB_SIGNS, _HEX_SIGN = r"[Bb][Ee][Aa][Rr][Ee][Rr]\s|github_pat_|gh[pousr]_|AKIA", "[0-9A-Fa-f]{32}"


def _needles(words: tuple) -> str:
    return "(?i)" + "|".join(map(_needle, dict.fromkeys((*words, "auth"))))


def _guarded(column: Column, steps: list[tuple[str, list[tuple[str, str]]]]) -> Column:
    """Chains of rules, each run only on lines with the sign that its rules need; names of keys need a sign after them too."""

    def one(sign: str, rules: list[tuple[str, str]]):
        if sign.startswith("(?i)"):
            return lambda v: F.when(v.rlike("[=:]"), F.when(v.rlike(sign), _chain(v, rules)).otherwise(v)).otherwise(v)
        return lambda v: F.when(v.rlike(sign), _chain(v, rules)).otherwise(v)

    for step in steps:
        column = let(column, one(*step))
    return column


def mask_log_line(column) -> Column:
    """Rules 1 to 9 for a log line: all but identity values."""
    key, named = sensitive_key(), _needles(SENSITIVE)
    steps = [
        # an unquoted value has no certain end, so the rest of the line goes
        (named, [(rf"(?i){_START}({key}\s*[=:]\s*).*$", "$1***"), (rf'(?i)("{key}"\s*:\s*)(?!["\s]).*$', '$1"***"')]),
        # empty fields, so that one doesn't take the next for its value
        (r"=[ \t]", [(rf"({_KEY}+)=(?=[ \t]+{_KEY}+=)", "$1=-")]),
        (named, [(rf'(?i)("{key}"\s*:\s*")(?:\\.|[^"\\])*(")', "$1***$2"), (f"(?i){_escaped(key)}", "$1***$2")]),
        (_BLOB_SIGNS, [*_BLOBS[:3], (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]+(?![A-Za-z0-9])", "***access-key***")]),
        ("eyJ", _BLOBS[3:4]),
        ("://", _BLOBS[4:]),
        (_HEX_SIGN, [(r"(?<![A-Za-z0-9])([0-9A-Fa-f]{8})[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", "$1...")]),
    ]
    return _guarded(text(column), steps)


def _prefix(value: str, limit: int = 8) -> str:
    """A value of more than ``limit`` bytes, cut between characters and marked; masked or cut values stay."""
    data = value.encode("utf-8", "replace")
    if len(data) <= limit or (len(data) == limit + 3 and value.endswith("...")):
        return value
    return data[:limit].decode("utf-8", "ignore") + "..."


def _identity_value(key: str, value: str) -> str:
    compact = re.sub("[^a-z0-9]", "", key.lower())
    if compact not in IDENTITY:
        return value
    if compact in ("actor", "auditactorid") and re.fullmatch(r"[^:]+:[^:]+:[0-9A-Fa-f]{8}\.\.\.", value):
        return value
    kind, slash, rest = value.partition("/")
    return kind + slash + _prefix(rest) if compact == "resource" and kind and rest else _prefix(value)


#: What a line must have for the pattern, the pattern, and what it becomes.
_IDENTITIES = [
    ('"', re.compile(r'"([A-Za-z0-9_.-]+)"(\s*:\s*)"((?:\\.|[^"\\])*)"'), '"{}"{}"{}"'),
    ('\\"', re.compile(r'\\"([A-Za-z0-9_.-]+)\\"(\s*:\s*)\\"((?:(?!\\").)*)\\"'), '\\"{}\\"{}\\"{}\\"'),
    ('"', re.compile(r'([A-Za-z0-9_.-]+)(\s*=\s*)"([^"\n]*)"'), '{}{}"{}"'),
    ("'", re.compile(r"([A-Za-z0-9_.-]+)(\s*=\s*)'([^'\n]*)'"), "{}{}'{}'"),
    ("=", re.compile(r"""([A-Za-z0-9_.-]+)(\s*=\s*)([^\s"'()]+)"""), "{}{}{}"),
    (":", re.compile(r"^(\s*[A-Za-z0-9_.-]+)(:\s*)(\S.*)$"), "{}{}{}"),
]


def _shorten(lines: pd.Series) -> pd.Series:
    def one(line: str) -> str:
        for sign, pattern, shape in _IDENTITIES:
            if sign in line:
                line = pattern.sub(lambda m, s=shape: s.format(m[1], m[2], _identity_value(m[1], m[3])), line)
        return line

    return lines.fillna("").map(one)


def shorten_identities(column: Column) -> Column:
    """Rule 10: values of identity keys keep eight bytes, whatever their quoting."""
    return F.pandas_udf(_shorten, StringType())(column)


def redact_log_line(column) -> Column:
    """The whole rule set for a log line."""
    return shorten_identities(mask_log_line(column))


def safe_pattern(pattern: str) -> bool:
    """Whether an extra pattern is narrow enough to run on any text: two literal characters first, at most 128 in all,
    one ``+`` at most, and no wildcard, group, anchor, alternative or other repetition."""
    if not 3 <= len(pattern) <= 128 or not re.match("[A-Za-z0-9_]{2}", pattern):
        return False
    bare = re.sub(r"\\[A-Za-z0-9_.*+?(){}|^$-]", "", re.sub(r"\[[^\]\[]*\]", "", pattern))
    if re.search(r"[\[\].*?(){}|^$\\-]", bare) or bare.count("+") > 1:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def redact_outbound(column, extra_patterns: tuple = (), extra_keys: tuple = (), shortened: tuple = SHORTENED) -> Column:
    """The rule set for one line of text that leaves the site. Extra patterns that aren't safe are ignored."""
    words = SENSITIVE + tuple(re.sub("[^a-z0-9]", "", k.lower()) for k in extra_keys if re.search("[A-Za-z0-9]", k))
    key, end = sensitive_key(words, "inside"), r"""[^\s&,;"')]+"""
    short = "|".join(_needle(re.sub("[^a-z0-9]", "", k.lower())) for k in shortened)
    steps = [(p, [(p, "***")]) for p in extra_patterns if safe_pattern(p)] + [
        (_needles(words), [
            (rf'(?i)("{key}"\s*:\s*")(?:\\.|[^"\\])*(")', "$1***$2"),
            (f"(?i){_escaped(key)}", "$1***$2"),
            (rf'(?i){_START}({key}\s*=\s*")[^"\n]*(")', "$1***$2"),
            (rf"(?i){_START}({key}\s*=\s*')[^'\n]*(')", "$1***$2"),
            (rf"(?i){_START}({key}\s*=\s*)\([^()]*\)", "$1***"),
            (rf"(?i){_START}({key}\s*=\s*)bearer\s+{end}", "$1***"),
            (rf"(?i){_START}({key}\s*=\s*){end}", "$1***"),
            (rf"(?i)^(\s*{key}:\s*).*$", "$1***"),
        ]),
        (_BLOB_SIGNS, [(r"(?i)\bbearer\s+\S+", "Bearer ***"), *_BLOBS[1:3]]),
        ("://", _BLOBS[4:]),
        ("eyJ", _BLOBS[3:4]),
        (_HEX_SIGN, [(r"(?<![A-Za-z0-9])([0-9A-Fa-f]{8})[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", "$1…")]),
        (r"=\S{9}", [
            (r"""(?i)(?<![A-Za-z0-9_.-])(resource=[^\s&,;"')/]+/[^\s&,;"')…]{8})[^\s&,;"')…][^\s&,;"')]*""", "$1…"),
            (rf"""(?i)(?<![A-Za-z0-9_.-])((?!resource=[^\s&,;"')/]+/){_KEY}*(?:{short}){_KEY}*=[^\s&,;"')…]{{8}})[^\s&,;"')…][^\s&,;"')]*""", "$1…"),
        ]),
    ]
    return _guarded(text(column), steps)
