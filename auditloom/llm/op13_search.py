"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

``index`` turns each partition of documents into shards of posting lists: compressed blocks of BLOCK postings, each with the
pairs of term frequency and document length that can be its best (no other posting has a higher frequency in a shorter
document), so that the exact maximum of a block is known for any statistics of the corpus.

``search`` joins the lists with the terms of the queries and brings those of one shard together. A query's lists are
ordered by their global bounds: those whose bounds sum to less than the score to beat are non-essential, and only
documents in the others are candidates. A candidate looks into a non-essential list only while its score, the maximum of its
block there and the bounds of the lists still to come can reach the score to beat; other blocks aren't decompressed. A task
keeps the best documents of each query over all its shards, and these heaps are merged, in two steps.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

TOP = 20
#: Documents and bytes of text of a shard at most (one document may be larger); postings of a block.
SHARD, SHARD_BYTES, BLOCK = 8192, 32 << 20, 128
#: Queries that are searched at a time, about; bytes of a text that are split at a time.
TOGETHER, PIECE = 1024, 1 << 22
#: Heaps of one query that meet in the first step of the merge.
HEAPS = 64

#: What separates terms becomes a space, and A-Z lower case; bytes above 127 belong to terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces."""
    data = text.encode().translate(_TERMS)
    at = 0
    while len(data) - at > PIECE and (end := data.find(b" ", at + PIECE)) >= 0:
        yield data[at:end].split()
        at = end
    yield data[at:].split() if at else data.split()


# --- numbers of seven bits a byte, the last with the high bit unset ---


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative ``values`` and where each ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        those = size > k
        out[(ends - size)[those] + k] = (values[those] >> 7 * k) & 127 | np.where(size[those] > k + 1, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    last = data < 128
    first = np.flatnonzero(np.concatenate(([True], last[:-1])))
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


# --- the index ---

#: A row without a term lists a shard's documents and their lengths in terms; the others are posting lists, with
#: 32-bit numbers in ``last`` (the last document of each block), ``begin`` (where it begins in the postings) and ``best`` (block,
#: frequency and document length).
INDEX = "shard long, term binary, df int, doc_ids array<long>, lengths array<long>, last binary, begin binary, best binary, postings binary"
_NAMES = [x.split(" ")[0] for x in INDEX.split(", ")]
_LISTS = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), *((n, pa.binary()) for n in _NAMES[5:])])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class Shard:
    """Documents of one shard while they are gathered."""

    def __init__(self):
        self.docs, self.lengths, self.sizes, self.terms, self.tfs, self.bytes = [], [], [], [], [], 0
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__

    def add(self, doc_id: int | None, text: str) -> None:
        found: Counter = Counter()
        for terms in terms_of(text):
            found.update(terms)
        if found:
            self.docs.append(doc_id)
            self.lengths.append(found.total())
            self.sizes.append(len(found))
            self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
            self.tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            self.bytes += len(text)

    def full(self) -> bool:
        return len(self.docs) >= SHARD or self.bytes >= SHARD_BYTES

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        none = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), none, pa.array([len(self.docs)], pa.int32()), pa.array([self.docs], pa.list_(pa.int64())), pa.array([self.lengths], pa.list_(pa.int64())), *[none] * 4], schema=_LISTS)
        term, tf, n = np.concatenate(self.terms), np.concatenate(self.tfs), np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(len(self.docs)), self.sizes)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        df = np.bincount(term, minlength=len(self.vocabulary))
        ends = np.cumsum(df)
        place = np.arange(len(term)) - np.repeat(ends - df, df)
        begins = place % BLOCK == 0
        at = np.flatnonzero(begins)  # the first posting of each block
        block = np.cumsum(begins) - 1
        gap = np.where(begins, doc, doc - np.concatenate(([0], doc[:-1])))
        data, stops = pack(np.stack([gap, tf], 1).ravel())
        starts = np.concatenate(([0], stops))[2 * at]  # of each block
        blocks = np.cumsum(-(-df // BLOCK))  # where the blocks of each term end
        first = np.concatenate(([0], blocks[:-1]))
        bytes_end = np.concatenate((starts, [len(data)]))[blocks]
        of_block = term[at]
        last = doc[np.concatenate((at[1:], [len(doc)])) - 1].astype(np.int32)
        begin = (starts - np.concatenate(([0], bytes_end[:-1]))[of_block]).astype(np.int32)
        # those of a block that no shorter document with as high a frequency comes before
        wide = int(n.max()) + 1
        rank = np.lexsort((n[doc], -tf, block))
        low = n[doc][rank] - block[rank] * wide
        best = np.ones(len(low), bool)
        best[1:] = low[1:] < np.minimum.accumulate(low)[:-1]
        keep = rank[best]
        tops = np.stack([block[keep] - first[term[keep]], tf[keep], n[doc[keep]]], 1).astype(np.int32)
        tops_end = np.cumsum(np.bincount(term[keep], minlength=len(df)))
        names = list(self.vocabulary)
        columns = [pa.array(np.full(len(df), shard)), pa.array(names, pa.binary()), pa.array(df.astype(np.int32)), *(pa.nulls(len(df), pa.list_(pa.int64())) for _ in range(2)), _binary(last, 4 * blocks), _binary(begin, 4 * blocks), _binary(tops, 12 * tops_end), _binary(data, bytes_end)]
        yield from pa.Table.from_arrays(columns, schema=_LISTS).to_batches(max_chunksize=16_384)


def index(docs: DataFrame) -> DataFrame:
    """The written INDEX of ``docs(doc_id, text)``: each partition makes shards of its own, so no text is shuffled.

    Documents without terms, null texts among them, are left out. Very long texts: whole, in pieces.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(), TaskContext.get().partitionId() << 20
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    shard.add(doc, text or "")
                    if shard.full():
                        yield from shard.rows(number)
                        shard, number = Shard(), number + 1
        yield from shard.rows(number)

    return written(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, INDEX), "index")


# --- the search ---


class Postings:
    """One posting list of a shard, with the score that each block and the whole list can give."""

    def __init__(self, row: dict, weight: int, impact):
        self.row, self.weight, self.impact, self.all = row, weight, impact, None
        tops = np.frombuffer(row["best"], np.int32).reshape(-1, 3).astype(np.int64)
        self.maxima = weight * np.maximum.reduceat(impact(tops[:, 1], tops[:, 2]), np.flatnonzero(np.diff(tops[:, 0], prepend=-1)))
        self.bound = int(self.maxima.max())

    def _decoded(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of some blocks, in order."""
        data, begin = np.frombuffer(self.row["postings"], np.uint8), np.frombuffer(self.row["begin"], np.int32)
        stop = np.append(begin[1:], len(data))
        both = unpack(np.concatenate([data[begin[b] : stop[b]] for b in blocks]) if len(blocks) < len(begin) else data).reshape(-1, 2)
        sizes = np.full(len(blocks), BLOCK)
        if blocks[-1] == len(begin) - 1:
            sizes[-1] = self.row["df"] - BLOCK * (len(begin) - 1)
        starts = np.cumsum(sizes) - sizes
        docs = np.cumsum(both[:, 0])
        docs -= np.repeat(docs[starts] - both[starts, 0], sizes)
        return docs, both[:, 1]

    def whole(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            docs, tf = self._decoded(np.arange(len(self.maxima)))
            self.all = docs, self.weight * self.impact(tf, lengths[docs])
        return self.all

    def of(self, docs: np.ndarray, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The scores of ``docs``, each within its block."""
        wanted = np.unique(blocks)
        if self.all is None and 2 * len(wanted) < len(self.maxima):
            there, tf = self._decoded(wanted)
            scores = self.weight * self.impact(tf, lengths[there])
        else:
            there, scores = self.whole(lengths)
        at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
        return np.where(there[at] == docs, scores[at], 0)

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that would have each document; the number of blocks if none."""
        return np.searchsorted(np.frombuffer(self.row["last"], np.int32), docs)


class Best:
    """The best ``k`` of one query so far: scores, whether the id is null, ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    @property
    def to_beat(self) -> int:
        """The least score that may still come in: an equal one can, with a smaller id."""
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.k else 1

    def take(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # those below the k-th need no sorting
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            those = scores >= least
            scores, null, ids = scores[those], null[those], ids[those]
        scores, null, ids = (np.concatenate(x) for x in zip(self.rows, (scores, null, ids), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.rows = scores[order], null[order], ids[order]


def best_of_shard(query: list[tuple[int, Postings]], best: Best, lengths: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
    """Block-Max MaxScore of a ``query`` (how often it has a term, and the term's list) over one shard."""
    query = sorted(((n * p.bound, n, p) for n, p in query if p.bound), key=lambda x: x[0])
    rest, least, skipped = 0, best.to_beat, 0  # rest: the bounds of the lists that are non-essential
    for bound, _, _ in query:
        if rest + bound >= least:
            break
        rest, skipped = rest + bound, skipped + 1
    if skipped == len(query):
        return
    scores = np.zeros(len(ids), np.int64)
    for _, n, postings in query[skipped:]:
        docs, own = postings.whole(lengths)
        scores[docs] += n * own
    docs = np.flatnonzero(scores)
    scores = scores[docs]
    for bound, n, postings in reversed(query[:skipped]):
        rest -= bound
        block = postings.block_of(docs)
        most = n * np.append(postings.maxima, 0)[block]
        hopeful = scores + most + rest >= least
        docs, scores, block = docs[hopeful], scores[hopeful], block[hopeful]
        if not len(docs):
            return
        inside = np.flatnonzero(block < len(postings.maxima))
        if len(inside):
            scores[inside] += n * postings.of(docs[inside], block[inside], lengths)
    those = scores >= least
    best.take(scores[those], null[docs[those]], ids[docs[those]])


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search_block(lists: DataFrame, wanted: dict[bytes, tuple[int, list[tuple[int, int]]]], n: int, total: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the heaps of each task. ``lists`` are whole shards, in order; ``wanted`` has each term's weight and queries."""
    shared = lists.sparkSession.sparkContext.broadcast(wanted)

    def impact(tf, length):
        return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * length * n // total))

    def run(batches) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Best] = {}

        def search(head: dict, rows: list[dict]) -> None:
            ids = np.array([-1 if x is None else x for x in head["doc_ids"]], np.int64)
            null, lengths = np.array([x is None for x in head["doc_ids"]]), np.array(head["lengths"], np.int64)
            queries = defaultdict(list)
            for row in rows:
                weight, asked = shared.value[row["term"]]
                postings = Postings(row, weight, impact)
                for item, times in asked:
                    queries[item].append((times, postings))
            for item, query in queries.items():
                if item not in heaps:
                    heaps[item] = Best(k)
                best_of_shard(query, heaps[item], lengths, null, ids)

        head, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    if head is not None:
                        search(head, rows)
                    head, rows = row, []
                else:
                    rows.append(row)
        if head is not None:
            search(head, rows)
        for item, best in heaps.items():
            scores, null, ids = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(scores)], ["item", "doc_id", "score"])

    return lists.mapInArrow(run, "item long, doc_id long, score long")


def search(lists: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``lists`` (an INDEX) for each row of ``queries(item_id, text)``.

    Queries are dealt into blocks of about TOGETHER, and each block's terms, weights and numbers are what is broadcast. Nulls: a
    null text has no terms and so no rows; an item with a null or repeated item_id is an item of its own. Very long
    queries: whole. Ties: the smaller doc_id, null last. Empty tables: no rows. Other columns are not read.
    """
    total = lists.where("term is null").select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms")).agg(F.sum("n"), F.sum("terms")).first()
    spark = lists.sparkSession
    items = written(queries.select(queries["item_id"], queries["text"].cast("string").alias("text")), "items").withColumn("item", F.monotonically_increasing_id())
    items = written(items, "numbered-items")
    found = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), F.lit(1))
    blocks = max(1, -(-items.count() // TOGETHER))
    asked = items.select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = written(asked.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", F.encode("term", "UTF-8").alias("term"), "times"), "asked")
    df = written(lists.select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    heaps = None
    for block in range(blocks):
        wanted: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
        for r in asked.where(F.col("block") == block).join(df, "term").toLocalIterator():  # the terms of the block's queries
            wanted.setdefault(bytes(r["term"]), (weight_of(total[0], r["df"]), []))[1].append((r["item"], r["times"]))
        terms = asked.where(F.col("block") == block).select("term").distinct()
        own = lists.join(terms, "term", "left_semi").select(*_NAMES).unionByName(lists.where("term is null"))
        found = _search_block(own.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()), wanted, total[0] or 1, total[1] or 1, k)
        heaps = found if heaps is None else heaps.unionByName(found)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    heaps = heaps.withColumn("heap", F.spark_partition_id() % HEAPS)
    for keys in (["item", "heap"], ["item"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return heaps.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}

ORACLE_SQL = {
    "op13_lexical_search": r"""
with words as (
  select row_number() over () as doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), docs as (select doc, doc_id, len(terms) as n from words where len(terms) > 0),
corpus as (select count(*) as total, sum(n)::bigint as terms from docs),
asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all
), postings as (
  select doc, term, count(*) as tf from (select doc, unnest(terms) as term from words) where term in (select term from asked) group by all
), weights as (
  select term, floor(1000 * ln((2 * any_value(total) + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, corpus group by term
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // corpus.terms))))::bigint as score
  from asked join postings using (term) join weights using (term) join docs using (doc), corpus group by item_id, doc, doc_id
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""
}
