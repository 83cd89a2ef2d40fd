"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a whole run of key characters in a sensitive context: near a sensitive word, before or after it, or inside
a PEM block. Its marginal size is what a zstandard frame of the surrounding text grows by when the candidate is added, with
a dictionary trained on the corpus' own lines and identifiers. Words and code that the surroundings or the dictionary know
add few bytes; secrets add nearly as many as a random string in their place. No length or mix of characters decides.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = r"passw|secret|token|api[_ ]?key|credential|private[_ ]?key|auth|bearer"
NEAR = re.compile(SENSITIVE, re.I | re.A)
PEM, PEM_END = re.compile(r"-----BEGIN [A-Z ]+-----"), "-----END "
#: Runs that are looked at, of so many characters at least; an equals sign parts a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}=*")
#: Characters between a sensitive word and a candidate; characters around a candidate that count as its surroundings.
REACH, AROUND = 64, 160
#: A candidate is incompressible from this share of what a seeded random string of its length (at most the last number)
#: adds to the same surroundings.
LEAST_SHARE, SEED, RANDOM_LENGTH = 0.72, 11, 4096
#: What primes the dictionary: identifiers on so many different lines at least, lines without their runs, and its bytes.
IDENTIFIERS, ON_LINES, LINES, DICTIONARY = 8192, 3, 2048, 16_384


def surroundings(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Identifiers and lines around sensitive words: the most frequent ones over the whole corpus, IDENTIFIERS and LINES at most.

    A line counts once, however many copies of its document there are, so a secret that is copied stays unknown; and lines
    lose their long runs before they count.
    """
    near = F.regexp_extract_all("text", F.lit(rf"(?i)[^\n]{{0,{REACH}}}(?:{SENSITIVE})[^\n]{{0,{REACH}}}"), F.lit(0))
    lines = written(docs.select(docs["text"].cast("string").alias("text")).where(F.col("text").rlike(f"(?i){SENSITIVE}")).select(F.explode(F.array_distinct(near)).alias("line")).distinct(), "lines")
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_]{3,32}(?![A-Za-z0-9_+/=])"), F.lit(0)))).alias("word"))
    top = words.groupBy("word").count().where(F.col("count") >= ON_LINES).orderBy(F.desc("count"), "word").limit(IDENTIFIERS)
    bare = lines.groupBy(F.regexp_replace("line", "[A-Za-z0-9+/_.=-]{12,}", " ").alias("line")).count().orderBy(F.desc("count"), F.xxhash64("line"), "line").limit(LINES)
    return [r[0] for r in top.collect()], [r[0] for r in bare.collect()]


def novelty_dictionary(words: list[str], lines: list[str]) -> bytes:
    """A zstandard dictionary: trained where there is enough to train on, otherwise the words and lines themselves."""
    import zstandard

    samples = [x.encode() for x in lines] + [(" ".join(words[i : i + 8]) + "\n").encode() for i in range(0, len(words), 8)]
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-DICTIONARY:]


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """What lies between the marks of PEM blocks."""
    at = 0
    while m := PEM.search(text, at):
        end = text.find(PEM_END, m.end())
        if end < 0:
            return
        yield m.end(), end
        at = end + len(PEM_END)


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Where candidates count, in order: around sensitive words and within PEM blocks, what overlaps as one."""
    zones = merge(((m.start() - REACH, m.end() + REACH) for m in NEAR.finditer(text)), _blocks(text) if "-----BEGIN " in text else ())
    low, high = next(zones, (0, -1))
    for a, b in zones:
        if a > high:
            yield low, high
            low = a
        high = max(high, b) if a <= high else b
    if high >= 0:
        yield low, high


class Scanner:
    def __init__(self, dictionary: bytes):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
        self.squeeze = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.random = "".join(random.Random(SEED).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=RANDOM_LENGTH))

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal bytes a character of text[start:end], as a share of those of a random string in its place.

        Copies of the candidate in the surroundings don't make it known.
        """
        candidate = text[start:end]
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).replace(candidate, "").encode()
        other, known = self.random[: end - start], len(self.squeeze(around))
        own, usual = ((len(self.squeeze(around + x.encode())) - known) / len(x) for x in (candidate, other))
        return own / usual if usual > 0 else 0.0

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def novel(self, text: str) -> list[tuple[int, int, int]]:
        """Incompressible whole runs in sensitive contexts, whatever the fixed patterns say of them: one pass over zones and runs."""
        found, zones = [], contexts(text)
        low, high = next(zones, (0, -1))
        for m in CANDIDATE.finditer(text) if high >= 0 else ():
            while high <= m.start():
                low, high = next(zones, (0, -1))
                if high < 0:
                    return found
            run = m.group().rstrip("=")
            if m.start() + len(run) < low:  # a run that reaches into the zone, or up to it, is taken whole
                continue
            start, end = m.start(), m.start() + len(m.group().rstrip(".-"))
            if end - start >= 12 and text[start - 1 : start] != "@" and text[end : end + 1] != "@" and self.novelty(text, start, end) >= LEAST_SHARE:
                found.append((start, 3, end))
        return found

    def scan(self, text: str) -> tuple[list, list]:
        base = self.base(text)
        return base, sorted(base + self.novel(text))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_last: list = []  # a worker's dictionary and the scanner made of it


def _scanner(shared) -> Scanner:
    if not _last or _last[0] is not shared.value:
        _last[:] = [shared.value, Scanner(shared.value)]
    return _last[1]


def _primed(docs: DataFrame):
    """The dictionary, broadcast: DICTIONARY bytes at most."""
    return docs.sparkSession.sparkContext.broadcast(novelty_dictionary(*surroundings(docs)))


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: counts by kind, the digest of the fixed patterns' spans, and all spans.

    Positions are code points, ends exclusive; a span of kind assign covers the whole match; one of kind novel is a run that
    the method reports, also where a fixed pattern has it. Nulls: a null text is an empty one; a null doc_id is kept. Very
    long texts and candidates: whole. Ties: spans that start together go by kind. Repeated rows: a row each, with equal
    results. Empty table: no rows. Other columns are not read.
    """
    shared = _primed(docs)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def one(scanner: Scanner, text: str) -> tuple:
        base, spans = scanner.scan(text)
        counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
        return *counts[:3], hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans), counts[3]

    def run(batches):
        scanner = _scanner(shared)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [one(scanner, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k - 1] for r in rows], kinds[k]) for k in range(1, 7))], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]`` (overlapping spans by one) and n_chars counted anew.

    An assignment keeps its name and operator. Other columns pass through, whatever their names; a null text stays null, an
    empty one empty. Very long texts and secrets: whole. Repeated rows stay and are changed alike. Empty table: no rows.
    """
    shared = _primed(docs)

    def clean(scanner: Scanner, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, kind, end in scanner.scan(text)[1]:
            if kind == 0:
                start = ASSIGN.match(text, start).start(2)
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = end
        return "".join(out) + text[at:] if out else text

    at = docs.columns.index("text")

    def run(batches):
        scanner = _scanner(shared)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield part.set_column(at, part.schema.field(at), pa.array([clean(scanner, t) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secrets": op1_secrets}
