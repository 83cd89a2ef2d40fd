"""Conversation structure repair: the cheapest edits that make roles alternate, told as an audit string.

The dynamic programme goes over a conversation's rows with four states: nothing is out yet, or a system, user or assistant
row came last. Each state holds the cost and the least of the cheapest audits that lead there. Audits share their
prefixes as linked nodes with ancestors at powers of two and rolling hashes, so that two of equal cost are compared by a search for
their longest common prefix.

Blank rows and repeats must go, whatever else is done, so they don't take part. A conversation of any length is split into
blocks of BLOCK rows: for each state before a block, the programme gives the costs of the states after it, and their order
by audit. No two audits over the same rows are a prefix of one another (an insertion belongs to the row that is kept after it),
so these 32 numbers are all that the choice of a way through the blocks needs. A last pass puts rows and audits
together, in order and row by row: a SHA-256 of a conversation can't be split, its memory is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

#: Rows of a conversation that the dynamic programme takes at a time.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Nothing is out yet; the last role that is out begins with s, u, a.
NONE, SYSTEM, USER, ASSISTANT = STATES = range(4)
_BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state that an inserted or changed role leads to.
_TURN = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A cost that no way has.
NEVER = 1 << 60
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Edit:
    """An audit as its last edit, linked to the others: ``up[k]`` is the node 2^k edits before."""

    __slots__ = ("depth", "hash", "letter", "up")

    def __init__(self, before: Edit | None, letter: str):
        self.letter, self.up = letter, []
        self.depth, self.hash = (before.depth + 1, (before.hash * _BASE + ord(letter)) % _PRIME) if before else (0, 0)
        k = 0
        while before is not None:
            self.up.append(before)
            before, k = before.up[k] if k < len(before.up) else None, k + 1

    def text(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def _ancestor(node: Edit, depth: int) -> Edit:
    k = len(node.up) - 1
    while node.depth > depth:
        while k >= len(node.up) or node.up[k].depth < depth:
            k -= 1
        node = node.up[k]
    return node


def _same(a: Edit, b: Edit) -> bool:
    """Whether two audits of equal depth are equal; equal hashes are verified, edit by edit, up to the node that both share."""
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def compare(a: Edit, b: Edit) -> int:
    """Below 0 if audit ``a`` comes before ``b`` in ASCII order; a prefix comes before what it begins."""
    x, y = _ancestor(a, min(a.depth, b.depth)), _ancestor(b, min(a.depth, b.depth))
    if _same(x, y):
        return a.depth - b.depth
    for k in reversed(range(len(x.up))):  # down to the first edits that differ, with the longest common prefix before them
        if k < len(x.up) and not _same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return ord(x.letter) - ord(y.letter)


def _next(state: int, initial: str) -> int | None:
    """The state after a kept role, if it may stand there."""
    to = _BY_INITIAL.get(initial)
    if to == SYSTEM:
        return SYSTEM if state == NONE else None
    return to if to is not None and _TURN[state] == to else None


def _ways(state: int, initial: str, truncated: bool) -> list[tuple[int, str, int]]:
    """(cost, edits, state after) of a row that may stay."""
    more = TRUNCATED * truncated
    ways = [(DELETE, "D", state)]
    for cost, before, at in ((0, "", state), (INSERT, "I", _TURN[state])):
        to = _next(at, initial)
        if to is not None:
            ways.append((cost + KEEP + more, before + "K", to))
        if to != _TURN[at]:  # else the same for more
            ways.append((cost + REROLE + more, before + "R", _TURN[at]))
    return ways


_EVERY = {(state, initial, truncated): _ways(state, initial, truncated) for state in STATES for initial in ("s", "u", "a", "") for truncated in (False, True)}


def cheapest(rows: list[tuple[str, bool]], start: int) -> dict[int, tuple[int, Edit]]:
    """Cost and least audit for each state that ``rows`` (initial, whether truncated) can lead to from ``start``."""
    now = {start: (0, Edit(None, ""))}
    for initial, truncated in rows:
        found: dict[int, tuple[int, Edit, str]] = {}
        for state, (cost, node) in now.items():
            for more, edits, to in _EVERY[state, initial if initial in _BY_INITIAL else "", truncated]:
                held = found.get(to)
                if held is None or cost + more < held[0]:
                    found[to] = (cost + more, node, edits)
                elif cost + more == held[0]:
                    order = compare(node, held[1]) if node is not held[1] else (edits > held[2]) - (edits < held[2])
                    if order < 0:
                        found[to] = (cost + more, node, edits)
        now = {}
        for to, (cost, node, edits) in found.items():
            for letter in edits:
                node = Edit(node, letter)
            now[to] = (cost, node)
    return now


def summary(rows: list[tuple[str, bool]]) -> tuple[list[int], list[int], list[str]]:
    """For each state before and after the rows, at 4 * before + after: cost, place among the audits from there, audit."""
    costs, places, audits = [NEVER] * 16, [0] * 16, [""] * 16
    for start in STATES:
        found = cheapest(rows, start)
        for place, to in enumerate(sorted(found, key=cmp_to_key(lambda a, b: compare(found[a][1], found[b][1])))):  # noqa: B023
            costs[4 * start + to], places[4 * start + to], audits[4 * start + to] = found[to][0], place, found[to][1].text()
    return costs, places, audits


def way_through(blocks: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The states before and after each block on the cheapest way from nothing to an end, by their costs and places."""
    now = {NONE: (0, 0)}  # the cost of each state, and its audit's place
    back = []
    for costs, places in blocks:
        best = {to: min((cost + costs[4 * s + to], place, places[4 * s + to], s) for s, (cost, place) in now.items()) for to in STATES}
        best = {to: x for to, x in best.items() if x[0] < NEVER}
        order = {x: place for place, x in enumerate(sorted({x[1:3] for x in best.values()}))}
        now = {to: (x[0], order[x[1:3]]) for to, x in best.items()}
        back.append({to: x[3] for to, x in best.items()})
    ends = {NONE: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}  # what closes an open turn
    to = min(now, key=lambda s: (now[s][0] + ends[s], now[s][1]))
    way = []
    for states in reversed(back):
        way.append((states[to], to))
        to = states[to]
    return way[::-1]


# --- the conversations' rows ---


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: ``rows(conv_id, turn, role, text)`` without, with emptied, cut, repeated or changed ones, by a CRC-32.

    A null in conv_id or turn counts as one space for the CRC-32, and a null role or text becomes one space.
    """
    own = [rows[c].cast("string") for c in ("conv_id", "turn", "role", "text")]
    conv, turn, role, text = (F.coalesce(c, F.lit(" ")) for c in own)
    fate = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.where(fate != 0).select(rows["conv_id"].cast("long"), rows["turn"].cast("long"), F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """The distinct ``rows(conv_id, turn, role, text, copies)``, written in order of conversation and turn.

    Adds ``conv`` (the id as a string, a space if null), ``digest`` of the text, and ``at``, which grows with the order.
    Equal rows are counted first, so many of them are one; rows of one turn go by role and by the text's digest; and a conversation
    with very many rows lies in several ranges.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    text = F.coalesce(F.col("text"), F.lit(" ")).alias("text")
    rows = rows.select("conv_id", conv, "turn", F.coalesce("role", F.lit(" ")).alias("role"), text, F.sha2(text, 256).alias("digest"), "copies")
    one = rows.groupBy("conv_id", "conv", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.any_value("text").alias("text"))
    keys = ["conv", "turn", "role", "digest"]
    return written(one.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "turns")


def _marked(turns: DataFrame) -> DataFrame:
    """``turns`` without texts: ``(conv, at, initial, blank, first, truncated)``. first: no earlier row has its role and text."""
    blank, ended = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = turns.select("conv", "at", "role", "digest", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~ended).alias("truncated"))
    earliest = rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("earliest"))
    joined = rows.join(earliest, ["conv", "role", "digest"])
    return joined.select("conv", "at", "initial", "blank", (F.col("at") == F.col("earliest")).alias("first"), "truncated")


def _summaries(live: DataFrame) -> DataFrame:
    """``(conv, block, costs, places, audits)`` of each block of ``live(conv, block, at, initial, truncated)`` rows."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["conv", "block", "costs", "places", "audits"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for conv, block, initial, truncated in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != (conv, block):
                    if rows:
                        out.append((*key, *summary(rows)))
                    key, rows = (conv, block), []
                rows.append((initial, truncated))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *summary(rows)), kinds, strict=True)], names)

    rows = live.repartition("conv", "block").sortWithinPartitions("conv", "block", "at").select("conv", "block", "initial", "truncated")
    return rows.mapInArrow(run, "conv string, block long, costs array<long>, places array<int>, audits array<string>")


def _chosen(summaries: DataFrame) -> DataFrame:
    """``(conv, block, cell)``: the place of each block's audit in its summary. A conversation has a row for BLOCK of its rows here."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        conv, blocks, numbers, out = None, [], [], []

        def close() -> None:
            out.extend((conv, n, 4 * a + b) for n, (a, b) in zip(numbers, way_through(blocks), strict=True))

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)], ["conv", "block", "cell"])

        for batch in batches:
            for own, block, costs, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own != conv:
                    if blocks:
                        close()
                    conv, blocks, numbers = own, [], []
                blocks.append((costs, places))
                numbers.append(block)
            if out:
                yield flushed()
                out.clear()
        if blocks:
            close()
            yield flushed()

    rows = summaries.select("conv", "block", "costs", "places").repartition("conv").sortWithinPartitions("conv", "block")
    return rows.mapInArrow(run, "conv string, block long, cell int")


class _Repair:
    """One conversation while its rows go by, with the blocks' audits before them."""

    def __init__(self, conv: str):
        self.conv, self.state, self.edits, self.audit, self.hash, self.some = conv, NONE, iter(""), [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.last: str | None = None

    def _put(self, role: str, text: str, state: int) -> None:
        self.hash.update(f"{'\n' if self.some else ''}{role}:{text}".encode())
        self.some, self.state = True, state

    def _insert(self) -> None:
        to = _TURN[self.state]
        self.audit.append("I")
        self.cost += INSERT
        self._put(_NAMES[to], "", to)

    def row(self, role: str, text: str, copies: int, blank: bool, first: bool, truncated: bool) -> None:
        initial = role[:1]
        legal = self.last is None or self.last + initial in ("su", "ua", "au")
        self.illegal += (not legal) + copies - 1  # a row after its copy never alternates
        self.last = initial
        gone = copies if blank else copies - first
        self.blank, self.duplicate = self.blank + copies * blank, self.duplicate + gone * (not blank)
        if not blank and first:
            self.truncated += truncated
            while (edit := next(self.edits)) == "I":
                self._insert()
            self.audit.append(edit)
            if edit == "D":
                self.cost += DELETE
            else:
                to = _next(self.state, initial) if edit == "K" else _TURN[self.state]
                self.cost += (KEEP if edit == "K" else REROLE) + TRUNCATED * truncated
                self._put(role if edit == "K" else _NAMES[to], text, to)
        if gone:
            self.audit.append("D" * gone)
            self.cost += DELETE * gone

    def end(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self._insert()
        return self.conv, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


REPAIRED = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _told(rows: DataFrame) -> DataFrame:
    """REPAIRED of each conversation of ``rows(conv, at, audit, role, text, copies, blank, first, truncated)``; a row with an audit begins a block."""
    names = [x.split(" ")[0] for x in REPAIRED.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        repair, out = None, []
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                for conv, audit, *row in zip(*(part.column(k).to_pylist() for k in range(8)), strict=True):
                    if repair is None or repair.conv != conv:
                        if repair is not None:
                            out.append(repair.end())
                        repair = _Repair(conv)
                    if audit is not None:
                        repair.edits = iter(audit)  # the block before is done
                    else:
                        repair.row(*row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if repair is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(repair.end(), kinds, strict=True)], names)

    order = rows.repartition("conv").sortWithinPartitions("conv", "at", F.col("audit").isNull())
    return order.select("conv", "audit", "role", "text", "copies", "blank", "first", "truncated").mapInArrow(run, REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of each conversation of ``rows(conv_id, turn, role, text, copies)``.

    Rows go by turn, nulls first, and those of one turn by role and text's digest. Nulls: rows without conv_id are one conversation; a
    null role or text is one space. Empty texts are blank; very long texts and conversations: whole. Repeated rows are
    duplicates. Ties between edits: the ASCII-least audit. Roles go by their first character; one that begins with no s, u
    or a can't be kept. Empty table: no rows. Other columns are not read.
    """
    turns = in_order(rows)
    marks = written(_marked(turns), "marks")
    live = marks.where("first and not blank").withColumn("block", F.shiftright("at", BLOCK.bit_length() - 1))
    summaries = written(_summaries(live), "summaries")
    audits = summaries.join(_chosen(summaries), ["conv", "block"]).select("conv", F.expr(f"block * {BLOCK}").alias("at"), F.element_at("audits", F.col("cell") + 1).alias("audit"))
    bodies = turns.select("at", "role", "text", "copies").join(marks.select("conv", "at", "blank", "first", "truncated"), "at")
    told = _told(bodies.unionByName(audits, allowMissingColumns=True))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = turns.groupBy("conv").agg(F.coalesce(span.try_cast("long"), F.lit(0)).alias("gaps"))
    return told.join(gaps, "conv")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages every conversation, repairs it, and returns every original conv_id, those too that lost all rows."""
    rows = table(spark, sf_dir, "conversations")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    every = rows.select(rows["conv_id"].cast("long").alias("conv_id"), conv).distinct()
    told = every.join(repair(damaged(rows)), "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
