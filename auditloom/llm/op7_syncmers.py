"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its s-mers is that of the first or the last one. That
depends on the k-mer alone, so two texts that share a passage choose the same anchors in it. A fingerprint keeps, for
each of 64 slots, the least hash of the anchors that fall in it; the share of equal slots estimates the share of
anchors in common. Beside it all anchors are matched by position: how many stay where they were in an edited text, and how
many another text has at one and the same distance.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

K, S, SLOTS = 12, 4, 64
#: Code points of one text that are looked at together.
BLOCK = 1 << 20
EMPTY = "-" * 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(K)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def syncmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers; a text shorter than K is one anchor, an empty one has none."""
    n = len(points)
    if n < K:
        return (np.zeros(1, np.int64), _mix((points * _POWERS[:n]).sum(keepdims=True) + np.uint64(n))) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    m = n - S + 1
    inner = points[:m].copy()
    for i in range(1, S):
        inner *= _ODD
        inner += points[i : i + m]
    inner = _mix(inner)
    low, width = inner, 1
    while width * 2 <= K - S + 1:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if width < K - S + 1:
        extra = K - S + 1 - width
        low = np.minimum(low[:-extra], low[extra:])
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[K - S :] == low))
    hashes = np.zeros(len(at), np.uint64)
    for i in range(K):
        hashes += points[at + i] * _POWERS[i]
    return at, _mix(hashes)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def anchored(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of a text; a long one goes in blocks."""
    found = [(0, *syncmers(code_points(text[: BLOCK + K - 1])))]
    found += [(i, *syncmers(code_points(text[i : i + BLOCK + K - 1]))) for i in range(BLOCK, len(text) - K + 1, BLOCK)]
    return np.concatenate([at + i for i, at, _ in found]), np.concatenate([h for _, _, h in found])


def slots_of(hashes: np.ndarray) -> str:
    """64 slots of 8 hex digits: the upper halves of the least hashes; an empty slot is ``--------``."""
    slots = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(slots, (hashes & np.uint64(SLOTS - 1)).astype(np.int64), hashes >> np.uint64(32))
    filled = slots != np.iinfo(np.uint64).max
    digits = slots.astype(">u4").tobytes().hex()
    return "".join(digits[8 * i : 8 * i + 8] if f else EMPTY for i, f in enumerate(filled.tolist()))


def fingerprint(text: str) -> tuple[str, int]:
    """The slots of a text's anchors, and how many anchors it has."""
    _, hashes = anchored(text)
    return slots_of(hashes), len(hashes)


def in_place(a: tuple, b: tuple) -> int:
    """How many anchors ``(positions, hashes)`` two texts have at the same positions."""
    least = min(len(a[0]), len(b[0]))
    if least and (a[0][:least] == b[0][:least]).all():  # the usual edit: the beginning is the same
        return int((a[1][:least] == b[1][:least]).sum())
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int((a[1][x] == b[1][y]).sum())


def at_one_distance(a: tuple, b: tuple) -> int:
    """The most anchors that two texts have at one distance between their positions, by the first place of each anchor."""
    (x, at), (y, to) = (np.unique(h, return_index=True) for _, h in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.unique(b[0][to[j]] - a[0][at[i]], return_counts=True)[1].max()) if len(i) else 0


def likeness(a: str, b: str) -> float:
    """Equal slots over slots that either fingerprint fills; two fingerprints without anchors are alike."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 8 * SLOTS, 8)]
    filled = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(filled) / len(filled) if filled else 1.0


def anchors(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, anchor)`` for every closed syncmer of ``docs(doc_id, text)``: a table to match positions in.

    A null text has none; ties and repeated rows: all anchors of each row. Very long texts: whole.
    """

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                at, hashes = anchored(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(at), pa.int64()), pa.array(at), pa.array(hashes.view(np.int64))], ["doc_id", "pos", "anchor"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, pos long, anchor long")


def shared_passages(anchor_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """For stated ``pairs(a, b)`` of documents: how many anchors lie at each offset of b's position from a's.

    An anchor that repeats in a document counts at its first place.
    """
    left = pairs.join(anchor_rows.withColumnsRenamed({"doc_id": "a", "pos": "pos_a"}), "a").groupBy("a", "b", "anchor").agg(F.min("pos_a").alias("pos_a"))
    right = pairs.join(anchor_rows.withColumnsRenamed({"doc_id": "b", "pos": "pos_b"}), "b").groupBy("a", "b", "anchor").agg(F.min("pos_b").alias("pos_b"))
    return left.join(right, ["a", "b", "anchor"]).groupBy("a", "b", (F.col("pos_b") - F.col("pos_a")).alias("offset")).agg(F.count(F.lit(1)).alias("anchors"))


def in_order(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs(doc_id, text)`` dealt by ranges of doc_id, each range followed by a copy of the row that comes next.

    Gives ``bucket, doc_id, text, is_next, copies``, and whether any row stands for several. Boundaries are approximate quantiles of doc_id (a few numbers); an id, or null,
    that holds several quantiles is parted by its texts' hashes. The first row of each range is found by a hash aggregate,
    so a text moves once. The last range is followed by the first row of all. Null ids come first; equal ids are ordered by
    the hash of their text, then by the text. Equal rows of an id that holds several quantiles follow each other, so they are
    counted where they are read and go as one row with its ``copies``.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    quantiles = Counter(int(x) for x in rows.stat.approxQuantile("key", [i / n for i in range(1, n)], 1 / (8 * n)))
    cuts = sorted(quantiles)
    steps = max(1, len(cuts)).bit_length()
    bounds = F.lit(np.array(cuts + [(1 << 63) - 1] * ((1 << steps) - len(cuts)), np.int64))  # one literal, however many cuts
    search = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(steps))]), F.lit(0), lambda low, step: F.when(F.element_at(bounds, low + step) <= F.col("key"), low + step).otherwise(low))
    hot = {k: c for k, c in quantiles.items() if c > 1}
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if hot:
        often = F.col("key").isin(*hot)
        rows = rows.where(~often).unionByName(rows.where(often).groupBy("key", "doc_id", "text", "h").agg(F.count(F.lit(1)).alias("copies")))
    parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in hot.items() for x in kv)), F.col("key")), F.lit(1)) if hot else F.lit(1)
    inside = F.floor(F.col("h") / F.lit(float(1 << 63)) * parts) if hot else F.lit(0)
    # a cut begins a range, and a hot id is a range of its own: what comes after it in the same range has a larger key
    after = F.when(F.col("key").isin(*hot), inside).otherwise(n + 1) if hot else F.lit(0)
    rows = rows.withColumn("bucket", (search if cuts else F.lit(0)).cast("long") * (n + 2) + after)
    # at most a few times n rows of numbers: one for each range
    heads = written(rows.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("head")), "heads").withColumnsRenamed({"bucket": "own"})
    before = Window.orderBy("own")
    last = F.max("own").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turn = heads.select("head.key", "head.h", F.coalesce(F.lag("own").over(before), last).alias("bucket"))
    firsts = rows.drop("bucket").join(F.broadcast(turn), ["key", "h"]).groupBy("bucket", "key", "h").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    firsts = firsts.select("bucket", "key", "h", "r.doc_id", "r.text", F.lit(True).alias("is_next"), F.lit(1).cast("long").alias("copies"))
    dealt = rows.select("bucket", "key", "h", "doc_id", "text", F.lit(False).alias("is_next"), "copies").unionByName(firsts)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "is_next", "key", "h", "text"), bool(hot)


def each_copy(rows: DataFrame, together: int = 4096) -> DataFrame:
    """``rows`` as often as ``copies`` says, those of one row in many tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / together))).alias("_part")
    dealt = rows.select("*", parts).repartition(n)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(together).cast("long"), F.col("copies") - F.col("_part") * together)))
    return dealt.select(*(c for c in rows.columns if c != "copies"), each.alias("_copy")).drop("_copy")


def next_edit_digest(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, and the text whose last quarter gives way to the beginning of the next document.

    Also how many anchors the text and its edited text have in the same places, and how many the next document has at one
    distance. Nulls: a null text is an empty one; a row with a null doc_id comes before all others. Very long texts: whole,
    in blocks. Repeated rows and equal ids: a row each, in order of the texts' hashes, each followed by the next. A single document is
    followed by itself. Empty texts have no anchors: alike to each other (1.0), unlike any other (0.0). Empty table: no
    rows. Other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors", "in_place_edited", "at_one_distance_next", "copies"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def told(now: tuple, after: tuple, copies: int) -> tuple:
        (d, t, a, f), (_, text, own, g_next) = now, after
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + text[:quarter]
        e = a if edited == t else anchored(edited)
        g = slots_of(e[1])
        return d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, g_next), len(a[0]), in_place(a, e), at_one_distance(a, own), copies

    def run(batches):
        held = None  # the row that waits for the next one
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for bucket, doc, text, is_next, copies in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    own = anchored(text)
                    now = (doc, text, own, slots_of(own[1]))
                    if held is not None and held[0] == bucket:
                        out.append(told(held[1], now, 1))
                    if copies > 1:  # all but the last are followed by their like
                        out.append(told(now, now, copies - 1))
                    held = None if is_next else (bucket, now)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long, in_place_edited long, at_one_distance_next long, copies long"
    rows, several = in_order(docs)
    found = rows.select("bucket", "doc_id", "text", "is_next", "copies").mapInArrow(run, schema)
    return each_copy(found) if several else found.drop("copies")


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_edit_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op7_syncmer_fingerprints": op7_syncmer_fingerprints}
