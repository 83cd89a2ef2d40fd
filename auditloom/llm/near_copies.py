"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Texts with the same set are one node. Candidates come from two sources. The first is SimHash with pigeonring filtering, as
in ``op3_simhash``, over fingerprints of five-word shingles: it finds what is within its few bits. At a similarity of 0.8
some ten of 64 bits differ, and no key of a fingerprint is short of that and still selective, so the second source are a
node's minima under many hash functions, a few to a band: two sets of similarity s share a band's key with probability
s^ROWS. Each candidate's similarity is counted from the two texts before it becomes a link, so no key links unlike texts.

First each node of a key makes a pair with the key's least node: that links most of what is alike with about a pair a node.
Then all pairs of a key whose ends are in different groups are compared. Keys with few nodes list them. In wide ones the nodes
outside of the largest group meet all nodes in tiles, which count what the sets have in common and give only links: the
rows are those of the nodes, not of their pairs, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op3_simhash import links as simhash_links
from .op3_simhash import majority, set_bits, shingle_hashes
from .shared import Scratch, components, written

SHINGLE, LIKE = 5, 0.8
#: At a similarity of 0.8 a pair shares a key with probability 1 - (1 - 0.8^5)^24 = 0.99993.
BANDS, ROWS = 24, 5
#: A key with more nodes is wide; so many nodes, or shingles of theirs, are one side of a tile.
FEW, TILE, TILE_SHINGLES = 16, 4096, 1 << 20
#: Of one bit of each minimum, so many agree at least if a pair is to be counted: at 0.8 nine tenths do, 4.4 deviations more.
AGREE = 94
#: Shingles of one text that are mixed at a time, and whose bits are counted at a time.
BLOCK, WIDE = 1024, 1 << 17

_random = np.random.default_rng(42)
_FLIP = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def hashed(text: str) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; none without words."""
    words = text.encode().lower().split()
    return shingle_hashes(words, SHINGLE) if words else np.zeros(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashed(text))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash; 0 without words."""
    blocks = range(0, len(hashes), WIDE)
    return majority(np.sum([set_bits(hashes[i : i + WIDE]) for i in blocks], axis=0)[None], len(hashes))[0] if len(hashes) else 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a non-empty set under each hash function."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[i : i + BLOCK] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def keys(least: np.ndarray) -> list[int]:
    """A signed key for each band."""
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def bits(least: np.ndarray) -> list[int]:
    """One bit of each minimum, in two signed numbers."""
    own = np.zeros(128, np.uint8)
    own[: len(least)] = (least >> np.uint64(20)).astype(np.uint8) & 1
    return np.packbits(own).view(np.int64).tolist()


SCHEMA = "file long, pos long, doc_id long, hash long, node long, n long, fp long, bits_a long, bits_b long, keys array<long>"


def marks(rows: DataFrame) -> DataFrame:
    """SCHEMA of ``rows(file, pos, doc_id, text)``: hash is the text's, node the set's, n its size, fp the SimHash; texts without words have no keys."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def one(text: str) -> tuple:
        all_hashes = hashed(text)
        found = np.unique(all_hashes)
        least = minima(found) if len(found) else None
        return (xxhash.xxh64_intdigest(text.encode()), xxhash.xxh64_intdigest(found.tobytes()), fingerprint(all_hashes)), len(found), bits(least) if len(found) else [0, 0], keys(least) if len(found) else []

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                told = [one(t or "") for t in part.column(3).to_pylist()]
                text, node, fp = (pa.array(np.array([x[0][k] for x in told], np.uint64).view(np.int64)) for k in range(3))
                longs = [pa.array(x, pa.int64()) for x in ([t[1] for t in told], [t[2][0] for t in told], [t[2][1] for t in told])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), text, node, longs[0], fp, longs[1], longs[2], pa.array([x[3] for x in told], pa.list_(pa.int64()))], names)

    return rows.mapInArrow(run, SCHEMA)


def confirmed(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], put: Callable) -> DataFrame:
    """Those of the written ``pairs(a, b)`` whose texts are similar enough; ``texts_of`` gives ``(node, text)`` of the nodes that it is asked for."""
    texts = put(texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()), "texts")
    ends = [texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")).hint("merge") for c in ("a", "b")]

    def run(batches):
        last = {}  # a hub's text comes many times in a row
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                a, b, held = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for i in range(part.num_rows):
                    for node, column in ((a[i], 2), (b[i], 3)):
                        if node not in last:
                            if len(last) >= 8:
                                last.pop(next(iter(last)))
                            last[node] = shingles(part.column(column)[i].as_py() or "")
                        else:
                            last[node] = last.pop(node)  # the newest comes last
                    held.append(similarity(last[a[i]], last[b[i]]) >= LIKE)
                yield part.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _met(keyed: DataFrame, put) -> DataFrame:
    """The rows of ``keyed(key, ...)`` whose key has other members, with how many it has and the least of them."""
    counts = put(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("centre")).where("members > 1"), "met")
    return put(keyed.join(counts.hint("merge"), "key"), "shared")


def _likely(pairs: DataFrame, nodes: DataFrame, put) -> DataFrame:
    """Distinct ``pairs(a, b)`` whose sizes and bits of minima allow the similarity."""
    told = put(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "asked")
    for c in ("a", "b"):
        told = told.join(nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_of_{c}") for x in ("n", "bits_a", "bits_b"))).hint("merge"), c)
    return told.where(_fits(F.col("n_of_a"), F.col("n_of_b"), *((F.col(f"bits_a_of_{c}"), F.col(f"bits_b_of_{c}")) for c in ("a", "b")))).select("a", "b")


def _apart(few: DataFrame) -> DataFrame:
    """All pairs of the keys with few members whose ends are in different groups, from ``few(key, node, root)``."""
    gathered = few.groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("all"))
    pairs = gathered.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.node < y.node and x.root <> y.root")
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _by_simhash(prints: DataFrame, put) -> DataFrame:
    """Candidates ``(a, b)`` by SimHash from ``prints(node, fp)``: equal fingerprints, and those that operator 3 links."""
    first = put(prints.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    equal = prints.join(first, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = simhash_links(first.select("fp"))
    for c in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(c), F.col("least").alias(f"to_{c}")), c)
    return equal.unionByName(near.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))


def links(nodes: DataFrame, prints: DataFrame, texts_of: Callable[[DataFrame], DataFrame], put: Callable) -> DataFrame:
    """Confirmed links ``(a, b)`` between ``nodes(node, n, bits_a, bits_b, keys)``, with their fingerprints ``prints(node, fp)``.

    ``texts_of`` gives ``(node, text)`` of the nodes that it is asked for.
    """
    shared = _met(nodes.select("node", "n", F.explode("keys").alias("key")), put)
    near = put(_by_simhash(prints, put), "near")
    first = near.unionByName(shared.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    linked = put(confirmed(put(_likely(first, nodes, put), "likely"), texts_of, put), "first")
    roots = put(components(linked, put=put).select("node", F.col("component").alias("root")), "roots")
    rooted = put(shared.select("key", "node", "n", "members").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    rest = put(confirmed(put(_likely(_apart(rooted.where(F.col("members") <= FEW)), nodes, put), "likely"), texts_of, put), "rest")
    return linked.unionByName(rest).unionByName(_tiled(rooted.where(F.col("members") > FEW), texts_of, put))


def _fits(n_a, n_b, bits_a, bits_b):
    """Whether sizes and bits of minima allow the similarity."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits_a, bits_b, strict=True)), F.lit(0))
    return (F.least(n_a, n_b) >= LIKE * F.greatest(n_a, n_b)) & (differ <= BANDS * ROWS - AGREE)


def _tiled(wide: DataFrame, texts_of: Callable[[DataFrame], DataFrame], put: Callable) -> DataFrame:
    """Links ``(a, b)`` between all like members of the keys of ``wide(key, node, n, root)`` that are in different groups, one for each member and group in a tile.

    One end of such a pair is outside of the key's largest group. So these members are dealt into the key's rows of tiles and all
    members into its columns; a tile holds both. Neither side of a tile has many more than TILE members or TILE_SHINGLES.
    """
    groups = wide.groupBy("key", "root").agg(F.struct(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n")).alias("size"))
    most = groups.groupBy("key").agg(F.max_by(F.struct("root", "size"), F.struct("size", "root")).alias("largest"), F.sum("size.members").alias("members"), F.sum("size.n").alias("n"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    cut = lambda members, n: F.greatest(F.ceil(members / TILE), F.ceil(n / TILE_SHINGLES), F.lit(1)).cast("long")
    most = put(most.select("key", F.col("largest.root").alias("largest"), cut(F.col("members"), F.col("n")).alias("across"), cut(F.col("members") - F.col("largest.size.members"), F.col("n") - F.col("largest.size.n")).alias("down")), "largest")
    mixed = put(wide.join(most.hint("merge"), "key"), "mixed")
    if mixed.isEmpty():
        return mixed.select(F.col("node").alias("a"), F.col("root").alias("b"))
    at, place = F.xxhash64("node", "key"), lambda down, across, asks: F.struct(down.alias("down"), across.alias("across"), F.lit(asks).alias("asks"))
    told = F.transform(F.sequence(F.lit(0).cast("long"), F.col("down") - 1), lambda k: place(k, F.pmod(at, F.col("across")), False))
    asks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda k: place(F.pmod(at, F.col("down")), k, True))
    dealt = mixed.select("key", "node", "root", F.explode(F.when(F.col("root") == F.col("largest"), told).otherwise(F.concat(told, asks))).alias("tile")).select("key", "node", "root", "tile.*")
    texts = put(texts_of(mixed.select("node").distinct()), "texts")
    made = dealt.join(texts.hint("merge"), "node").groupBy("key", "down", "across").applyInArrow(_links_of_tile, "a long, b long")
    return put(made.distinct(), "tiled")


def _links_of_tile(tile: pa.Table) -> pa.Table:
    """Links ``(a, b)`` of the rows ``tile(node, root, asks, text)`` that ask to the others whose sets are like theirs, one to each other group."""
    node, root = (tile.column(c).to_numpy() for c in ("node", "root"))
    asks = np.array(tile.column("asks").to_pylist(), bool)
    sets = [shingles(t.as_py() or "") for t in tile.column("text")]
    told, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    sizes = np.array([len(sets[i]) for i in told], np.int64)
    every = np.concatenate([sets[i] for i in told]) if len(told) else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(told)), sizes)[order]
    a, b = [], []
    for i in asking:
        start, end = (np.searchsorted(every, sets[i], side) for side in ("left", "right"))
        runs = end - start
        found = owner[np.repeat(start - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]  # the owners of each run, one run after the other
        common = np.bincount(found, minlength=len(told))
        like = np.flatnonzero((common / np.maximum(len(sets[i]) + sizes - common, 1) >= LIKE) & (root[told] != root[i]))
        for k in like[np.unique(root[told[like]], return_index=True)[1]]:
            a.append(node[i])
            b.append(node[told[k]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def placed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns that name each row by its file and place in it, and their names; written first if it doesn't come from files."""
    names = [next(n for n in map(f"_{c}{{}}".format, range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("file", "pos")]
    made = None
    if not any(c.lower() == "_metadata" for c in docs.columns):
        try:
            made = docs.withColumns({names[0]: F.xxhash64("_metadata.file_path"), names[1]: F.col("_metadata.row_index")})
        except AnalysisException:  # not read from Parquet files
            pass
    if made is None:
        back = [c if c.lower() != "_metadata" else f"{c}_of_docs" for c in docs.columns]
        rows = written(docs.toDF(*back), "rows")
        made = rows.withColumns({names[0]: F.xxhash64("_metadata.file_path"), names[1]: F.col("_metadata.row_index")}).toDF(*docs.columns, *names)
    return made, *names


def distinct_rows(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of ``docs(doc_id, text)``, all its columns as they are.

    The row with the least doc_id stays, one with a null doc_id only if its group has no other; of rows that repeat
    the doc_id, the one with the least hash of its text; of equal rows any one, which makes no difference. A null text is an
    empty one; texts without words are copies of each other. Very long texts: whole. Empty table: no rows. Columns of any
    name pass through.
    """
    put = Scratch(docs.sparkSession, "near-copies")
    rows, file, pos = placed(docs)
    text = rows["text"].cast("string")
    marked = put(marks(rows.select(rows[file].alias("file"), rows[pos].alias("pos"), rows["doc_id"].cast("long"), text)), "marks")
    best = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "file", "pos")
    nodes = put(marked.groupBy("node").agg(F.min(best).alias("best"), *(F.first(c).alias(c) for c in ("n", "bits_a", "bits_b", "keys"))), "nodes")
    prints = put(marked.select("node", "fp").distinct(), "fingerprints")  # a set has several if its shingles repeat

    def texts_of(asked: DataFrame) -> DataFrame:
        # three numbers a text asked for: Spark broadcasts them below spark.sql.autoBroadcastJoinThreshold, and the texts stay where they are
        wanted = put(nodes.join(asked, "node", "left_semi").select("node", F.col("best.file").alias("file"), F.col("best.pos").alias("pos")), "wanted")
        return rows.select(rows[file].alias("file"), rows[pos].alias("pos"), text.alias("text")).join(wanted, ["file", "pos"]).select("node", "text")

    groups = components(links(nodes, prints, texts_of, put), put=put).withColumnRenamed("component", "root")
    kept = nodes.select("node", "best").join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    kept = written(kept.select(F.col("best.file").alias(file), F.col("best.pos").alias(pos)), "kept")
    put.clear()
    return rows.join(kept.hint("merge"), [file, pos], "left_semi").select(*(rows[c] for c in docs.columns))
