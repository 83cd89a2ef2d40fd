"""Quality classification by co-training.

Two logistic models see different views of a document: its content (character classes, words and lines of the text) and
its metadata (source, language and length, no text). Over some rounds each labels the unlabelled documents it is surest of
for the other one; the surest are sought among all unlabelled documents, on Spark. Both are then calibrated on labelled
documents that neither has learned from, and their calibrated scores are combined.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

#: Bound of the fit: labelled documents (a quarter of them for calibration).
LABELLED = 16_000
#: Rounds; documents a round and class that a view may label; how sure it must be; their weight in the fit.
ROUNDS, EXCHANGED, SURE, WEIGHT = 5, 400, 0.97, 0.3
#: A document is accepted from this probability of good quality.
ACCEPT = 0.5
#: Bytes of one text that are looked at together.
BLOCK = 1 << 20

CLASSES = 9


def _class(b: int) -> int:
    """Class of a byte: lower, upper, digit, blank, line end, sentence mark, bracket or quote, symbol, beyond ASCII."""
    c = chr(b)
    return 8 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in "\n\r" else 3 if c.isspace() else 5 if c in ".,;:" else 6 if c in "'\"()[]{}-" else 7


_CLASS = np.array([_class(b) for b in range(256)], np.int16)
CONTENT, METADATA = CLASSES * CLASSES + 5 + 6, 8 + 16 + 24
VIEWS = (slice(0, CONTENT), slice(CONTENT, CONTENT + METADATA))


def content_view(text: str) -> np.ndarray:
    """Shares of character-class pairs over the whole text, and what its words and lines are like."""
    data, pairs = np.frombuffer(text.encode(), np.uint8), np.zeros(CLASSES * CLASSES)
    for i in range(0, len(data), BLOCK):
        c = _CLASS[data[i : i + BLOCK + 1]]
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    words = text.split()
    n, kinds = len(words), set(words)
    length = sum(map(len, words)) / n if n else 0.0
    like = [len(kinds) / n if n else 0.0, len(kinds) / n**0.7 if n else 0.0, length / 10, np.log1p(n) / 10, sum(map(str.isupper, words)) / n if n else 0.0]
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    m = max(1, len(filled))
    layout = [np.log1p(len(lines)) / 10, np.log1p(len(text) / m) / 10, len(set(filled)) / m, (len(lines) - len(filled)) / len(lines), np.log1p(max(map(len, lines))) / 10, len(text) == 0]
    return np.concatenate([pairs / max(1, len(data)), like, layout])


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the length's power of two; unknown values are values of their own."""
    out = np.zeros(METADATA)
    out[zlib.crc32((lang or "").encode()) % 8] = 1
    out[8 + zlib.crc32((source or "").encode()) % 16] = 1
    out[24 + (0 if n_chars is None or n_chars < 0 else 1 + min(int(n_chars).bit_length(), 22))] = 1
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """What the views see: text, source, lang and the length that the metadata tells, that of the text if they tell none."""
    told = docs["n_chars"].try_cast("long") if "n_chars" in docs.columns else F.length(docs["text"].cast("string")).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(docs[c].cast("string").alias(c) for c in ("text", "source", "lang")), told.alias("n_chars"))


def _views(part: pa.RecordBatch) -> np.ndarray:
    columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "source", "lang", "n_chars")]
    found = [np.concatenate([content_view(t or ""), metadata_view(s, x, n)]) for t, s, x, n in zip(*columns, strict=True)]
    return np.array(found, np.float32).reshape(len(found), CONTENT + METADATA)


def _features(rows: DataFrame, *keys: str) -> DataFrame:
    """The columns ``keys`` of ``rows`` (longs), and ``x``, both views."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                x = pa.FixedSizeListArray.from_arrays(pa.array(_views(part).ravel()), CONTENT + METADATA).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keys), x], [*keys, "x"])

    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", x array<float>")


def _matrix(lists) -> np.ndarray:
    """The rows of a column of feature lists."""
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, CONTENT + METADATA).astype(np.float64)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Model:
    """Both views' weights on standardised features, and the calibrated combination; None where nothing could be learned.

    ``surest(beta, taken)`` gives for each (learner, label) the features of unlabelled documents that the other view is
    surest of, among those that the learner hasn't ``taken``, with their keys.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, surest: Callable):
        self.beta = None
        if min((y == 1).sum(), (y == 0).sum()) < 8:
            return
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self.standard(x)
        hold = np.arange(len(y)) % 4 == 0
        own, taken = [(x[~hold], y[~hold], np.ones((~hold).sum())) for _ in VIEWS], (set(), set())
        self.fit(own)
        for _ in range(ROUNDS):
            found = surest(self, taken)
            for (learner, label), (keys, rows) in sorted(found.items()):
                a, b, w = own[learner]
                own[learner] = np.concatenate([a, self.standard(rows)]), np.concatenate([b, np.full(len(rows), label)]), np.concatenate([w, np.full(len(rows), WEIGHT)])
                taken[learner].update(keys)
            if not any(len(keys) for keys, _ in found.values()):
                break
            self.fit(own)
        held = self.raw(x[hold])
        self.platt = np.array([fit_logistic(z[:, None], y[hold], np.ones(hold.sum()), 1e-3) for z in held.T])
        self.joint = fit_logistic(held * self.platt[:, 0] + self.platt[:, 1], y[hold], np.ones(hold.sum()), 1e-2)

    def fit(self, own: list) -> None:
        self.beta = [fit_logistic(a[:, v], b, w) for (a, b, w), v in zip(own, VIEWS, strict=True)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Each view's log odds for standardised features."""
        return np.column_stack([np.clip(x[:, v] @ b[:-1] + b[-1], -30, 30) for v, b in zip(VIEWS, self.beta, strict=True)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality by each view and by both."""
        if self.beta is None:
            return np.ones((len(x), 3))
        z = self.raw(self.standard(x)) * self.platt[:, 0] + self.platt[:, 1]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([z, z @ self.joint[:-1] + self.joint[-1]]), -30, 30)))


def _surest_in(pool: DataFrame) -> Callable:
    """The search for the surest documents of ``pool(h, x)``: each task keeps its own EXCHANGED a slot, Spark the best of these."""

    def surest(model: Model, taken: tuple[set, set]) -> dict:
        shared = pool.sparkSession.sparkContext.broadcast((model.mean, model.spread, model.beta, [np.array(sorted(t), np.int64) for t in taken]))  # some thousand numbers

        def run(batches):
            mean, spread, beta, out = shared.value
            best = {slot: (np.zeros(0), np.zeros(0, np.int64), np.zeros((0, CONTENT + METADATA), np.float32)) for slot in range(4)}
            for batch in batches:
                h, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                standard = (x - mean) / spread
                for slot in range(4):
                    learner, label = divmod(slot, 2)
                    v, b = VIEWS[1 - learner], beta[1 - learner]
                    p = 1 / (1 + np.exp(-np.clip(standard[:, v] @ b[:-1] + b[-1], -30, 30)))
                    sure = np.round(p if label else 1 - p, 9)
                    at = np.flatnonzero((sure >= SURE) & ~np.isin(h, out[learner]))
                    if len(at):
                        s, k, f = (np.concatenate(y) for y in zip(best[slot], (sure[at], h[at], x[at].astype(np.float32)), strict=True))
                        _, first = np.unique(k, return_index=True)  # equal documents are one
                        order = first[np.lexsort([k[first], -s[first]])][:EXCHANGED]
                        best[slot] = s[order], k[order], f[order]
            for slot, (s, k, f) in best.items():
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), slot, np.int32)), pa.array(s), pa.array(k), pa.array(list(f), pa.list_(pa.float32()))], ["slot", "sure", "h", "x"])

        found, told = written(pool.mapInArrow(run, "slot int, sure double, h long, x array<float>"), "sure"), {}
        for slot in range(4):
            rows = found.where(F.col("slot") == slot).dropDuplicates(["h"]).orderBy(F.desc("sure"), "h").limit(EXCHANGED).select("h", "x").toArrow()
            order = np.argsort(rows["h"].to_numpy())
            told[divmod(slot, 2)] = rows["h"].to_numpy()[order].tolist(), _matrix(rows["x"])[order] if len(order) else np.zeros((0, CONTENT + METADATA))
        return told

    return surest


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on LABELLED rows of ``labels(doc_id, quality)``, those with the least hashes, and on all unlabelled documents.

    Features of the unlabelled documents are computed once and written; every round looks through all of them. Equal
    documents (in all that the views see) count once there.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").cast("long").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(LABELLED)
    rows = _rows(docs)
    learned = _features(rows.join(F.broadcast(chosen), "doc_id"), "y").toArrow()
    y, x = learned["y"].to_numpy(), _matrix(learned["x"])
    order = np.lexsort(np.column_stack([x, y]).T)  # the same fit whatever the order of rows
    x, y = x[order], y[order]
    if min((y == 1).sum(), (y == 0).sum()) < 8:
        return Model(x, y, None)
    # a null doc_id has no label; its rows are dealt by their hash
    keyed = _features(rows.withColumn("h", F.xxhash64("text", "source", "lang", "n_chars")), "doc_id", "h").withColumn("key", F.coalesce("doc_id", "h")).withColumn("told", F.col("doc_id").isNotNull())
    known = marked.select(F.col("doc_id").alias("key"), F.lit(True).alias("told")).distinct()
    pool = written(keyed.join(known, ["key", "told"], "left_anti").select("h", "x"), "pool")
    return Model(x, y, _surest_in(pool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, accepted, content_score, metadata_score)`` for every row of ``docs(doc_id, text, source, lang[, n_chars])``.

    Nulls: a null text is an empty one; null sources, languages and lengths are values of their own; a null doc_id is kept
    and never has a label. Without 8 labels of each class nothing is learned and every document is accepted with score 1.
    Very long texts: whole, in blocks. Ties and repeated rows: a row each, with equal scores. Empty table: no rows. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                p = shared.value.scores(_views(part).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (p[:, 2], p[:, 2] >= ACCEPT, p[:, 0], p[:, 1]))], ["doc_id", "score", "accepted", "content_score", "metadata_score"])

    return _rows(docs).mapInArrow(run, "doc_id long, score double, accepted boolean, content_score double, metadata_score double")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns, whatever their names; odd rows go as in ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_length = "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns = {c: part.column(part.schema.get_field_index(c)) for c in ("text", "source", "lang")}
                length = part.column(part.schema.get_field_index("n_chars")) if has_length else pc.utf8_length(columns["text"])
                seen = pa.RecordBatch.from_arrays([*columns.values(), length], [*columns, "n_chars"])
                yield part.filter(pa.array(shared.value.scores(_views(seen).astype(np.float64))[:, 2] >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality": op5_quality}
