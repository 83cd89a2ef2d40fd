"""Best-fit packing: documents, cut where they are too long, into sequences of at most so many tokens.

Best-fit decreasing takes the documents from the longest to the shortest and puts each into the tightest open sequence that
still holds it, which a segment tree over the remaining capacities finds in logarithmic time. Equal lengths are alike to
it, so the driver gets a number of pieces for each length (as many numbers as a sequence has tokens) and plans for runs of
equal lengths what would happen to each in turn. The plan's moves are broadcast, and every piece finds its sequence from
its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op8_bpe import read_ranks
from .shared import table, written

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers (about 200 bytes each); characters of a text that are cut into words at a time.
REMEMBERED, BLOCK = 1_000_000, 1 << 20

#: A space beside other white space, and the spaces that no match of the vocabulary's pattern reaches across.
_ODD = re.compile(r" \s|[^\S ] ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Words:
    """Ids of texts by the words between single spaces, which the vocabulary's pattern never joins; each word once."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokens)}
        self.plain = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.array([len(t) for t in tokens])
        self.known: dict[str, bytes] = {}

    def _packed(self, text: str) -> bytes:
        return np.array(self.plain(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word behind a space; words that have no white space at their ends in one call."""
        bare = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        ids = np.array(self.plain("".join([f" {w}" for w in bare])), "<u4")
        ends = np.cumsum([1 + len(w.encode()) for w in bare], dtype=np.int64)
        cuts = (4 * np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 4).tolist()
        data = ids.tobytes()
        found = {w: data[a:b] for w, a, b in zip(bare, [0, *cuts], cuts, strict=False)}
        found.update((w, self._packed(f" {w}")) for w in words if w not in found)
        return found

    def _block(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known = {}
        found = self._learn(list({w for w in words if w not in self.known}))
        self.known.update(found)
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out, at, first = [], 0, True
        while at <= len(text):
            end = text.find(" ", at + BLOCK) if len(text) - at > BLOCK else -1
            while end >= 0 and not _SAFE.match(text, end):
                end = text.find(" ", end + 1)
            block = text[at : end if end >= 0 else len(text)] if at or end >= 0 else text
            words = _SAFE.split(block) if _ODD.search(block) else block.split(" ")
            if first:
                out.append(self._packed(words[0]))
                words, first = words[1:], False
            out.append(self._block(words))
            if end < 0:
                break
            at = end + 1
        return b"".join(out)


class Tightest:
    """A segment tree over capacities 0 to ``top``: which of them have open sequences."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.some = [0] * (2 * self.leaves)

    def put(self, at: int, there: bool) -> None:
        """Say whether capacity ``at`` has open sequences."""
        at += self.leaves
        self.some[at] = int(there)
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def least(self, wanted: int) -> int:
        """The least capacity of at least ``wanted`` that has open sequences; -1 if none has."""
        at = wanted + self.leaves
        if self.some[at]:
            return wanted
        while at > 1 and not (at % 2 == 0 and self.some[at + 1]):  # up to where a right neighbour has some
            at //= 2
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


MOVES = ("length", "rank", "sequence", "each", "offset")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` of pieces by length: the moves, ordered, and how many sequences there are.

    A move (MOVES) says that pieces of this length from this rank on go into sequences from this one on, so many into
    each, the first of them at the offset. The last ``length`` is the end of all.
    """
    tree, open_at, moves, made = Tightest(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.least(length)
            if room < 0:  # none is open: as many new ones as the rest needs
                room, each = capacity, capacity // length
                runs = [(made, -(-left // each))]
                made += runs[0][1]
            else:
                runs, each = open_at.pop(room), room // length
                tree.put(room, False)
            while runs and left:
                start, n = runs.pop()
                full = min(n, left // each)
                parts = [(start, full, each)] if full else []
                if full < n and left > full * each:  # the last ones share one sequence
                    parts.append((start + full, 1, left - full * each))
                done = 0
                for first, many, per in parts:
                    moves.append((length, rank, first, per, capacity - room))
                    rank, left, done = rank + many * per, left - many * per, done + many
                    rest = room - per * length
                    if rest:
                        open_at.setdefault(rest, []).append((first, many))
                        tree.put(rest, True)
                if done < n:
                    runs.append((start + done, n - done))
            if runs:
                open_at.setdefault(room, []).extend(runs)
                tree.put(room, True)
    return np.array(sorted(moves), np.int64).reshape(-1, len(MOVES)), made


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every document: ``nth`` counts the pieces of one length within the partition ``part``.

    A document is its ids and END. One of over ``capacity`` is cut into pieces of that many tokens, the first of which
    takes what is over. A string that names a special token is ordinary text.
    """
    import public_tokenizers

    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if len(tokens) > 1_000_000:
        raise ValueError("a vocabulary of over a million tokens is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern or public_tokenizers.PATTERN))
    names = [x.split(" ")[0] for x in PIECES.split(", ")]
    end = np.array([END], "<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        words, part = _words(shared), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    data = memoryview(words.encode(text or "") + end)
                    n = len(data) // 4
                    cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out.append((doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), part, int(seen[b - a])))
                        seen[b - a] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, PIECES)


_last: list = []  # a worker's vocabulary and the words made of it


def _words(shared) -> Words:
    if not _last or _last[0] is not shared.value:
        _last[:] = [shared.value, Words(*shared.value)]
    return _last[1]


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written PIECES with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its ``nth`` in its partition and what the partitions before have: one row for each
    partition and length. The plan has a move for each run of equal pieces that share a fate: a few thousand,
    however many documents there are.
    """
    counts = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    moves, _ = best_fit(by_length, capacity)
    if len(moves) > capacity * capacity:
        raise ValueError("the plan is larger than its bound")
    shared = cut.sparkSession.sparkContext.broadcast(moves)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        length, rank, sequence, each, offset = shared.value.T
        ends = {n: k for k, n in enumerate(length.tolist(), 1)}  # where the moves of a length end
        starts = {n: k for k, n in reversed(list(enumerate(length.tolist())))}
        for batch in batches:
            own, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.zeros(len(own), np.int64)
            for n in np.unique(own).tolist():
                those = own == n
                at[those] = starts[n] + np.searchsorted(rank[starts[n] : ends[n]], place[those], "right") - 1
            inside = place - rank[at]
            found = [pa.array(sequence[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its place in a sequence of at most ``capacity`` tokens.

    Nulls: a null text is an empty one (a single END), a null doc_id is kept. Very long texts: whole, in blocks; their
    ids are held at once, four bytes each. Ties: pieces of one length are alike and go in the order they are read. Repeated
    rows: a document each. Empty table: no rows. Other columns are not read.
    """
    return placed(written(pieces(docs, path, pattern, capacity), "pieces"), capacity)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op12_packing": op12_packing}
