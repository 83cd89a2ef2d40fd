"""Language identification with interpolated Kneser-Ney character models.

The corpus gives the counts of character 4-grams of each language; lower orders use continuation counts, and every
order is interpolated with the one below. Counts, continuation counts and totals of contexts are taken on Spark over all
n-grams. A model is a few sorted arrays of 64-bit n-gram hashes beside the log probabilities of all languages. A document
goes to the language with the least cross-entropy a character. Scale and rejection are calibrated on documents that the
counts have not seen.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

ORDER, DISCOUNT = 4, 0.75
#: Bound of the model that is broadcast: so many pairs of n-gram and language, and each order's share of them. What
#: doesn't fit goes by the order below, with exactly its weight; all counts and totals are those of all n-grams.
CELLS, SHARES = 4_000_000, (0.05, 0.15, 0.3, 0.5)
#: Letters of text that are scored together.
BLOCK = 1 << 20
#: Scales of the confidence that are tried; share of a language's documents that are not rejected, and a margin in nats.
SCALES, KEPT, MARGIN = tuple(0.5 * 1.5**k for k in range(12)), 0.995, 0.1
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others being one 0, after ORDER - 1 zeros; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    kept = np.where(letter, points, 0)[letter | np.concatenate([[False], letter[:-1]])]
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), kept.astype(np.uint64)])


def hashes(s: np.ndarray) -> np.ndarray:
    """For each character after the first ORDER - 1: hashes of the n-grams of orders 1 to ORDER that end in it, then of
    the contexts of orders 2 to ORDER."""
    ends = [s + np.uint64(1)]
    for _ in range(ORDER - 1):
        ends.append(np.concatenate([ends[0][:1], ends[-1][:-1]]) * _BASE + ends[0])
    return np.stack([*(h[ORDER - 1 :] for h in ends), *(h[ORDER - 2 : -1] for h in ends[:-1])])


def held_out(doc_id):
    """Documents that are never learned from."""
    return _fold(doc_id) == 0


def _fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, a, b, n)`` of the 4-grams of all of ``docs(lang, text)``: a and b hold two characters each.

    Each task adds up its own counts first.
    """

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # hash, four characters, count

        def out():
            for lang, (_, c, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(c[:, 0] << 32 | c[:, 1]), pa.array(c[:, 2] << 32 | c[:, 3]), pa.array(n)], ["lang", "a", "b", "n"])
            held.clear()

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if len(s := symbols(text)):
                        by.setdefault(lang, []).append(s)
                for lang, found in by.items():
                    s = np.concatenate(found)  # each begins with its zeros, so only whole windows of one text are taken
                    whole = np.concatenate([np.arange(len(x)) >= ORDER - 1 for x in found])[ORDER - 1 :]
                    h = hashes(s)[ORDER - 1][whole]
                    h, first, n = np.unique(h, return_index=True, return_counts=True)
                    at = np.flatnonzero(whole)[first]
                    c = np.stack([s[at + k] for k in range(ORDER)], axis=1).astype(np.int64)
                    if lang in held:
                        h, c, n = (np.concatenate(x) for x in zip(held[lang], (h, c, n), strict=True))
                        h, first, back = np.unique(h, return_index=True, return_inverse=True)
                        c, n = c[first], np.bincount(back, n).astype(np.int64)
                    held[lang] = h, c, n
            if sum(len(n) for _, _, n in held.values()) > 2_000_000:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def orders_of(counts: DataFrame) -> list[DataFrame]:
    """``(lang, a, b, n)`` of orders 1 to ORDER: the counts, and below them how many distinct n-grams end in each shorter one."""
    shorter = {3: ("a & 4294967295", "b"), 2: ("0L", "b"), 1: ("0L", "b & 4294967295")}
    found = [counts]
    for m in range(ORDER - 1, 0, -1):
        a, b = shorter[m]
        found.insert(0, written(found[0].groupBy("lang", F.expr(a).alias("a"), F.expr(b).alias("b")).agg(F.count(F.lit(1)).alias("n")), "types"))
    return found


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys``, and whether each is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Model:
    """Per order: sorted hashes of n-grams with the log probability in each language, and of contexts with the log weight of the order below."""

    def __init__(self, langs: list[str], characters: int, orders: list[tuple]):
        """``orders`` has for each order (language number, four characters, count, total of the context) of its n-grams."""
        self.langs, self.floor = langs, 1.0 / (1 + characters)
        self.scale, self.reject = 10.0, {}
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for m, (lang, points, n, total) in enumerate(orders if langs else [], 1):
            rows = hashes(np.concatenate([points, np.zeros((len(points), ORDER - 1), np.int64)], axis=1).astype(np.uint64).ravel())[:, :: 2 * ORDER - 1] if len(points) else np.zeros((2 * ORDER - 1, 0), np.uint64)
            union, first, at = np.unique(rows[m - 1], return_index=True, return_inverse=True)
            contexts, of = np.unique(self._context(rows, m), return_inverse=True)
            seen, weight = np.zeros((len(union), len(langs))), np.ones((len(contexts), len(langs)))
            share = np.maximum(n - DISCOUNT, 0) / total
            seen[at, lang] = share
            np.subtract.at(weight, (of, lang), share)  # what no n-gram of the model takes is left to the order below
            weight = np.maximum(weight, 1e-9)
            below = np.exp(self.log_probabilities(rows[:, first], m - 1)) if m > 1 else np.full((len(union), len(langs)), self.floor)
            mine = np.empty(len(union), np.int64)
            mine[at] = of
            self.orders.append((union, np.log(seen + weight[mine] * below).astype(np.float32), contexts, np.log(weight).astype(np.float32)))

    @staticmethod
    def _context(rows: np.ndarray, m: int) -> np.ndarray:
        return rows[ORDER + m - 2] if m > 1 else np.zeros(rows.shape[1], np.uint64)

    def log_probabilities(self, rows: np.ndarray, order: int = ORDER) -> np.ndarray:
        """For each column of ``hashes``, the log probability of its character in each language, from ``order`` down."""
        out, rest = np.zeros((rows.shape[1], len(self.langs)), np.float32), np.arange(rows.shape[1])
        for m in range(order, 0, -1):
            union, logp, contexts, back = self.orders[m - 1]
            wanted = rows[m - 1] if len(rest) == rows.shape[1] else rows[m - 1][rest]
            at, there = _lookup(union, wanted)
            out[rest[there]] += logp[at[there]]
            rest = rest[~there]
            if not len(rest):
                return out
            at, there = _lookup(contexts, self._context(rows, m)[rest])
            out[rest[there]] += back[at[there]]
        out[rest] += np.log(self.floor)
        return out

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats a character in each language; NaN for a text without letters. A long text goes in blocks."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held, size = [], 0

        def flush() -> None:
            if held:
                scores = self.log_probabilities(np.concatenate([g for _, g in held], axis=1))
                for (i, g), s in zip(held, np.add.reduceat(scores, np.cumsum([0, *(g.shape[1] for _, g in held[:-1])]), axis=0, dtype=np.float64), strict=True):
                    sums[i] -= s
                    counts[i] += g.shape[1]

        for i, text in enumerate(texts):
            s = symbols(text)
            for k in range(0, len(s) - ORDER + 1, BLOCK):
                held.append((i, hashes(s[k : k + BLOCK + ORDER - 1])))
                size += held[-1][1].shape[1]
                if size >= BLOCK // 4:
                    flush()
                    held, size = [], 0
        flush()
        return sums / np.where(counts, counts, np.nan)[:, None]

    def probabilities(self, entropy: np.ndarray, scale: float | None = None) -> np.ndarray:
        raised = np.exp(-(scale or self.scale) * (entropy - entropy.min(axis=1, keepdims=True)))
        return raised / raised.sum(axis=1, keepdims=True)


def _collected(order: DataFrame, langs: list[str], totals: DataFrame, most: int) -> tuple:
    """One order's n-grams for the model: at most ``most``, those with the largest share in their language."""
    context = [F.col("lang"), F.when(F.col("a") > 0, F.col("a")).otherwise(0).alias("ca"), F.expr("shiftright(b, 32)").alias("cb")]
    whole = order.groupBy(*context).agg(F.sum("n").alias("total"))
    top = order.join(F.broadcast(totals), "lang").orderBy(F.desc(F.col("n") / F.col("all")), "lang", "a", "b").limit(most).select("n", "a", "b", *context)
    rows = top.join(whole, ["lang", "ca", "cb"]).select("lang", "a", "b", "n", "total").orderBy("lang", "a", "b").toArrow()
    place = {x: i for i, x in enumerate(langs)}
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    points = np.stack([a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF], axis=1)
    return np.array([place[x] for x in rows["lang"].to_pylist()], np.int64), points, rows["n"].to_numpy(), rows["total"].to_numpy()


def train(docs: DataFrame, cells: int = CELLS) -> Model:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that have text and lang and are not held out.

    A quarter of them (the next remainder of the checksum) is kept for calibration; a language that has no other
    documents is learned from it all the same. Every document counts, and one that repeats counts as often.
    """
    known = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull() & ~held_out(docs["doc_id"])).select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"), (_fold(docs["doc_id"]) == 1).alias("aside"))
    common = known.where("not aside").select("lang").distinct()
    rare = known.where("aside").join(F.broadcast(common), "lang", "left_anti").select("lang", "text")  # a row a language
    counts = written(gram_counts(known.where("not aside").select("lang", "text").unionByName(rare)), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))  # a row a language
    langs = sorted(r[0] for r in totals.select("lang").collect())
    if not langs:
        return Model([], 0, [])
    orders, most = orders_of(counts), cells // max(4, len(langs))
    model = Model(langs, orders[0].select("b").distinct().count(), [_collected(t, langs, totals, max(1, int(most * share))) for t, share in zip(orders, SHARES, strict=True)])
    return calibrated(model, known.where("aside").select("lang", "text"))


def calibrated(model: Model, docs: DataFrame) -> Model:
    """Choose the scale by likelihood over all of ``docs(lang, text)``, and for each language the entropy that KEPT of its documents stay below.

    A language without documents here has the bound of all languages together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS bounds its size

    def run(batches):
        m = shared.value
        place = {x: i for i, x in enumerate(m.langs)}
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                truth = np.array([place[x] for x in part.column(0).to_pylist()])
                entropy = m.cross_entropy(part.column(1).to_pylist())
                some = np.flatnonzero(~np.isnan(entropy[:, 0]))
                if len(some):
                    entropy, truth = entropy[some], truth[some]
                    fits = [np.log(np.maximum(m.probabilities(entropy, s)[np.arange(len(truth)), truth], 1e-9)) for s in SCALES]
                    yield pa.RecordBatch.from_arrays([pa.array([m.langs[t] for t in truth]), pa.array(entropy[np.arange(len(truth)), truth]), *map(pa.array, fits)], ["lang", "own", *names])

    names = [f"fit{k}" for k in range(len(SCALES))]
    rows = written(docs.mapInArrow(run, "lang string, own double, " + ", ".join(f"{n} double" for n in names)), "fits")
    quantile = F.percentile_approx("own", KEPT, 10_000).alias("own")
    fits = rows.agg(*(F.avg(n).alias(n) for n in names), quantile).first()
    if fits["own"] is not None:
        model.scale = max(SCALES, key=lambda s: (round(fits[names[SCALES.index(s)]], 6), -s))
        each = {r["lang"]: r["own"] for r in rows.groupBy("lang").agg(quantile).collect()}  # a row a language
        model.reject = {x: each.get(x, fits["own"]) + MARGIN for x in model.langs}
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, cross_entropy, rejected)`` for every whole text of ``docs(doc_id, text)``.

    ``score`` is the calibrated probability of the language; ``rejected`` marks a text whose entropy is above what
    its language's documents have. Nulls: a null text, or one without letters (emoji are none), is ``und`` with score 0;
    a null doc_id counts as the empty text in the checksum. Very long texts: whole, in blocks. Ties between languages: the
    first by name. Without anything to learn from, all is ``und``. Repeated rows: a row each. Empty table: no rows. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS bounds its size

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                rows = [(UNKNOWN, 0.0, None, True)] * part.num_rows
                if m.langs:
                    entropy = m.cross_entropy([t or "" for t in part.column(2).to_pylist()])
                    known = np.flatnonzero(~np.isnan(entropy[:, 0]))
                    best, p = entropy[known].argmin(axis=1), m.probabilities(entropy[known]) if len(known) else None
                    for j, (i, k) in enumerate(zip(known.tolist(), best.tolist(), strict=True)):
                        e = float(entropy[i, k])
                        rows[i] = m.langs[k], float(p[j, k]), e, e > m.reject.get(m.langs[k], np.inf)
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


QUERIES = {"op9_language": op9_language}
