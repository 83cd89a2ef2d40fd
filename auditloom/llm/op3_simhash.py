"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints that differ in at most ``bits`` bits, cut into m segments on a ring, have a start from which
every chain of 1, 2, ... m consecutive segments stays within its share of the budget: a chain of length l differs in
at most l * bits / m bits. So the first segments of such a chain are equal, and the next ones differ in one bit at
most, hence one half of those is equal too. Start, equal segments and equal half make the key under which fingerprints
meet; the chain rule then prunes pairs before their full distance is counted.

Only distinct fingerprints meet, and a key gives the links of a spanning forest, not its pairs. A key with very many
fingerprints isn't gathered: its members meet under masks instead, where equal masked values are linked to their least
member, so each row makes a fixed number of rows.
"""

from __future__ import annotations

from itertools import chain, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, table, written

SEED, SHINGLE, BITS, SEGMENTS = 42, 3, 3, 8
#: Fingerprints of one key that are compared in one task; a key with more goes by masks.
GATHERED = 4096
#: Shingles of one text that are hashed at a time.
BLOCK = 1 << 17


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words than ``size`` are one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def _view(hashes: np.ndarray, view: int) -> np.ndarray:
    """The hashes as another view sees them: view 0 takes them as they are, others mix them anew."""
    if not view:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * view & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, size: int = SHINGLE, views: int = 1) -> list[int]:
    """A fingerprint for each view: a bit is set if over half of the shingles' hashes set it; no words give 0."""
    words = text.encode().lower().split()
    if not words:
        return [0] * views
    n, sums = max(1, len(words) - size + 1), np.zeros((views, 64), np.int64)
    for i in range(0, n, BLOCK):
        hashes = shingle_hashes(words[i : i + BLOCK + size - 1], size)
        for v in range(views):
            sums[v] += set_bits(_view(hashes, v))
    return majority(sums, n)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(sums: np.ndarray, n: int) -> list[int]:
    """A fingerprint of each row of sums over n hashes: bits that over half of them set."""
    return np.packbits(sums * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, size: int = SHINGLE, views: int = 1) -> DataFrame:
    """``(doc_id, fp[, fp1, ...])``, a signed long for each view; a null text is an empty one."""
    names = [f"fp{v or ''}" for v in range(views)]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found = np.array([fingerprint(t or "", size, views) for t in part.column(1).to_pylist()], np.uint64).reshape(-1, views)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[:, v].copy().view(np.int64)) for v in range(views))], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def _turn(x: np.ndarray, start: int) -> np.ndarray:
    """``x`` turned on the ring so that bit ``start`` comes first."""
    return x if not start else (x >> np.uint64(start)) | (x << np.uint64(64 - start))


class Ring:
    """The lengths that follow from ``bits`` and ``segments``: equal bits, then bits with one difference at most."""

    def __init__(self, bits: int = BITS, segments: int = SEGMENTS):
        if 64 % segments or segments <= bits:
            raise ValueError("segments must divide 64 and be more than bits")
        self.bits, self.segments, self.width = bits, segments, 64 // segments
        self.equal = (ceil(segments / bits) - 1) * self.width if bits else 64
        self.once = min(64, (ceil(2 * segments / bits) - 1) * self.width) - self.equal if bits else 0
        self.half = self.once // 2

    def chain(self, difference: np.ndarray) -> np.ndarray:
        """Places of the turned differences whose every chain of first segments stays within its proportional budget.

        What one length prunes, the next doesn't look at; the last chain is the whole ring, so its budget is the full
        Hamming check.
        """
        kept, total = np.arange(len(difference)), np.zeros(len(difference), np.int64)
        for length in range(1, self.segments + 1):
            total += np.bitwise_count(difference >> np.uint64((length - 1) * self.width) & np.uint64((1 << self.width) - 1))
            fits = total * self.segments <= length * self.bits
            kept, total, difference = kept[fits], total[fits], difference[fits]
        return kept

    def key_mask(self, half: int) -> int:
        """Bits of a turned fingerprint that make the key: the equal ones and one half of the next."""
        return (1 << self.equal) - 1 | ((1 << self.half) - 1) << self.equal + half * (self.once - self.half)

    def masks(self, half: int) -> np.ndarray:
        """Sets of bits outside the key such that two members within the budget are equal outside one of the sets."""
        free = [i for i in range(64) if not self.key_mask(half) >> i & 1]
        near = [i for i in free if i < self.equal + self.once]
        sets = {sum(1 << i for i in c) for c in combinations(free, min(self.bits, len(free))) if sum(i in near for i in c) <= 1}
        return np.array(sorted(sets), np.uint64)


def keys(fps: DataFrame, ring: Ring) -> DataFrame:
    """``(start, half, part, fp)``: each fingerprint under each of its keys."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for s in range(ring.segments):
                for h in range(2):
                    part = _turn(fp, s * ring.width) & np.uint64(ring.key_mask(h))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), 2 * s + h, np.int32)), pa.array(part.view(np.int64)), batch.column(0)], ["place", "part", "fp"])

    return fps.select("fp").mapInArrow(run, "place int, part long, fp long")


def forest(members: np.ndarray, start: int, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the members that are near each other, by the chain rule and then the distance."""
    n, root = len(members), np.arange(len(members))
    turned, a, b = _turn(members, start), [], []
    for i in range(n - 1):
        difference = turned[i + 1 :] ^ turned[i]
        near = ring.chain(difference) + i + 1
        others = near[root[near] != root[i]]
        if len(others):
            roots, first = np.unique(root[others], return_index=True)
            a += [i] * len(first)
            b += others[first].tolist()
            root[np.isin(root, roots)] = root[i]
    return members[a], members[b]


def links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all that are within ``bits`` bits of each other."""
    ring = Ring(bits, segments)
    dealt = keys(fps, ring)
    counts = dealt.groupBy("place", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(counts, "met")  # only keys that two fingerprints share go on
    rows = dealt.join(met, ["place", "part"])

    def gather(batches):
        held = None  # the last key's rows, which the next batch may go on with
        for batch in chain(batches, [None]):
            columns = [c.to_numpy() for c in batch.columns] if batch else [np.zeros(0, np.int64)] * 3
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            place, part, fp = columns[0], columns[1], columns[2].view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])])) if len(fp) else np.zeros(0, np.int64)
            if batch is not None and len(starts):
                held, starts = [c[starts[-1] :] for c in columns], starts[:-1]
                ends = np.append(starts[1:], len(fp) - len(held[0]))[: len(starts)]
            else:
                ends = np.append(starts[1:], len(fp))[: len(starts)]
            two = np.flatnonzero(ends - starts == 2)
            turns = place[starts[two]] // 2 * ring.width
            found = []
            for turn in np.unique(turns):
                x, y = (fp[starts[two[turns == turn]] + k] for k in (0, 1))
                near = ring.chain(_turn(x ^ y, int(turn)))
                found.append((x[near], y[near]))
            for i in np.flatnonzero(ends - starts > 2):
                found.append(forest(fp[starts[i] : ends[i]], int(place[starts[i]]) // 2 * ring.width, ring))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    few = rows.where(F.col("n") <= GATHERED).select("place", "part", "fp")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    few = few.repartition(parts, "place", "part").sortWithinPartitions("place", "part", "fp").mapInArrow(gather, "a long, b long")
    if met.where(F.col("n") > GATHERED).isEmpty():
        return few.distinct()

    def spread(batches):
        for batch in batches:
            places, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for place in np.unique(places):
                own, masks = fps[places == place], ring.masks(int(place) % 2)
                turned = _turn(own, int(place) // 2 * ring.width)
                for i, x in enumerate(masks):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), place * 65536 + i, np.int64)), pa.array((turned & ~x).view(np.int64)), pa.array(own.view(np.int64))], ["mask", "rest", "fp"])

    spread_rows = rows.where(F.col("n") > GATHERED).select("place", "fp").mapInArrow(spread, "mask long, rest long, fp long")
    stars = spread_rows.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all"))
    stars = stars.where("a <> z").select("a", F.explode("all").alias("b")).where("a <> b")
    return few.unionByName(stars).distinct()


def _links_of_view(rows: DataFrame, name: str, bits: int, segments: int) -> DataFrame:
    """Links ``(a, b)`` between first fingerprints whose documents are near each other in another view."""
    pairs = written(rows.select("fp", name).distinct(), name)
    least = written(pairs.groupBy(name).agg(F.min("fp").alias("rep")), f"{name}-least")
    equal = pairs.join(least, name).where("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    near = links(least.select(F.col(name).alias("fp")), bits, segments)
    ends = [least.select(F.col(name).alias(c), F.col("rep").alias(f"to_{c}")) for c in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    return equal.unionByName(near)


def groups(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS, views: int = 1) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Fingerprints within ``bits`` bits are linked, and linked groups grow together; component_id is the least doc_id
    reached. With more ``views``, each an independent fingerprint of the same shingles, documents are linked that are
    within ``bits`` in any of them: edits that flip a few bits too many in one view are caught by another.
    Nulls: a null text is an empty one (fingerprint 0); a null doc_id is kept, and is the component_id only
    if its group has no other. Very long texts: whole, in blocks. Ties: a hash set in just half of the shingles leaves the bit
    0; equal fingerprints are one node. Repeated rows: a row each. Empty table: no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, size, views), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = links(distinct, bits, segments)  # equal first fingerprints are one node
    for v in range(1, views):
        linked = linked.unionByName(_links_of_view(rows, f"fp{v}", bits, segments))
    joined = components(linked).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = distinct.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    grouped = written(rooted.join(least, "root").select("fp", "component_id"), "grouped")
    # equal fingerprints may be a third of all rows: adaptive execution splits such a partition of this inner join
    return rows.join(grouped, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
