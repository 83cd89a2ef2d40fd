"""Conversation repair, packing and ranked search, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditloom.llm import op11_conversations as turns
from auditloom.llm import op12_packing as packing
from auditloom.llm import op13_search as searching

# --- conversations ---

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def accepted(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)) is not None


def prefix(roles):
    """Whether the roles can still become a whole conversation."""
    return re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r in roles)) is not None


def brute_force(rows):
    """The contract word by word: every way to edit, with whole audits and outputs, the best for each number of rows and role sequence."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    known = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = {(): (0, "", ())}  # by the last role that is out, and whether any is: cost, audit, outputs

    def add(to, key, cost, audit, out):
        if prefix([r for r, _ in out]) and (key not in to or (cost, audit) < to[key][:2]):
            to[key] = (cost, audit, out)

    def key_of(out):
        return (out[-1][0][:1],) if out else ()

    def inserted(states):
        for _ in range(3):
            for cost, audit, out in list(states.values()):
                for role in ("user", "assistant"):
                    new = (*out, (role, ""))
                    add(states, key_of(new), cost + 3, audit + "I", new)
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        to = {}
        for cost, audit, out in inserted(dict(best)).values():
            add(to, key_of(out), cost + 4, audit + "D", out)
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                for edit, own, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    new = (*out, (own, text))
                    add(to, key_of(new), cost + price + more, audit + edit, new)
        best = to
    cost, audit, out = min(x for x in inserted(dict(best)).values() if accepted([r for r, _ in x[2]]))
    count = Counter(faults)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(n, seed, longest=9):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if r.random() < 0.6 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if r.random() < 0.05 else turn * r.choice((1, 1, 1, 2)), role, r.choice(["Yes.", "No", "So it is!", " ", "", None, "Why? \n", "well"])))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None), (3, 5, "user", "Again."), (3, 5, "user", "Again.")]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_repairs_equal_brute_force(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rows = conversations(400, block)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as block", "'x' as at", "'x' as conv", "'x' as copies", "'x' as first").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in turns.op11_conversation_repair(spark, str(tmp_path)).collect()}
    by_conv = defaultdict(list)
    for row in damaged(rows):
        by_conv[row[0]].append(row)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {r[0] for r in rows}
    for conv, own in got.items():
        assert own == (brute_force(by_conv[conv]) if by_conv[conv] else nothing), (conv, by_conv[conv])


def test_a_long_conversation_is_repaired_alike_in_one_block_and_in_many(spark, monkeypatch):
    rows = [(7, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 40} " + random.Random(-t).choice(["a.", "b", ""]), 1) for t in range(3000)] + [(8, 0, "user", "same.", 500_000), (9, None, "user", "x" * 2_000_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    found = []
    for block in (16, 4096):
        monkeypatch.setattr(turns, "BLOCK", block)
        found.append(sorted(tuple(r) for r in turns.repair(df).collect()))
    assert found[0] == found[1]
    by_conv = {r[0]: r for r in found[0]}
    assert by_conv["8"][2:7] == (499_999, 0, 499_999, 4 * 499_999 + 3, "K" + "D" * 499_999 + "I")
    expected = brute_force([r[:4] for r in rows[:400]])
    monkeypatch.setattr(turns, "BLOCK", 32)
    assert [tuple(r[f] for f in FIELDS) for r in turns.repair(df.where("conv_id = 7 and turn < 400")).collect()] == [expected]


def test_audits_compare_by_their_common_prefix_and_verify_equal_hashes(monkeypatch):
    r = random.Random(1)
    root = turns.Edit(None, "")
    nodes = [root]
    for _ in range(400):
        nodes.append(turns.Edit(r.choice(nodes[-40:]), r.choice("DIKR")))
    pairs = [(r.choice(nodes), r.choice(nodes)) for _ in range(3000)]
    sign = [(a.text() > b.text()) - (a.text() < b.text()) for a, b in pairs]
    assert [np.sign(turns.compare(a, b)) for a, b in pairs] == sign
    monkeypatch.setattr(turns, "_PRIME", 2)  # nearly all hashes collide now
    twins, again = {id(root): root}, [root]
    for node in nodes[1:]:
        twins[id(node)] = turns.Edit(twins[id(node.up[0])], node.letter)
        again.append(twins[id(node)])
    for a, b in pairs:
        x, y = twins[id(a)], twins[id(b)]
        if x.depth == y.depth:
            assert turns._same(x, y) == (a.text() == b.text())


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op11_conversation_repair(spark, str(tmp_path)).collect() == []


# --- packing ---


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a document at a time: the remaining capacities."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 64, 100])
    lengths = [r.randint(1, r.choice([3, capacity])) for _ in range(r.randint(1, 400))] + [r.randint(1, capacity)] * r.randint(0, 200)
    counts = Counter(lengths)
    moves, made = packing.best_fit(counts, capacity)
    rooms = [capacity] * made
    by_length = defaultdict(list)
    for length, rank, sequence, each, offset in moves.tolist():
        by_length[length].append((rank, sequence, each, offset))
    for length, own in sorted(by_length.items(), reverse=True):
        for (rank, sequence, each, offset), end in zip(own, [x[0] for x in own[1:]] + [counts[length]], strict=True):
            for k in range(end - rank):
                assert capacity - rooms[sequence + k // each] == offset + k % each * length
                rooms[sequence + k // each] -= length
    assert sorted(rooms) == one_by_one(lengths, capacity)


TEXTS = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n a \t b\x1c c", "it's we'll ' s 'S", "Größe ñandú 日本語 😀 ½ ² Ⅳ x  y z   w", "<|endoftext|> is text", "end. \n", "a\x00b \x00 c", "don't\tstop  now\r\n\r\nok"]


def test_words_give_the_ids_of_the_tokenizer(tokenizer, monkeypatch, prose):
    import public_tokenizers

    from auditloom.llm.op8_bpe import read_ranks

    words = packing.Words(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    r = random.Random(5)
    texts = TEXTS + [prose(200, i) for i in range(5)] + ["".join(r.choice(["a", "ba", " ", " ", "\n", ".", "'s", "7", "é", "　"]) for _ in range(60)) for _ in range(400)]
    for block in (1 << 20, 7):
        monkeypatch.setattr(packing, "BLOCK", block)
        for text in texts + texts[::-1]:
            assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer(text), text


def test_pieces_hold_their_documents_and_sequences_have_no_gaps(docs, odd, prose, tokenizer):
    rows = [(i, prose(random.Random(i).choice([1, 5, 300, 900]), i % 40)) for i in range(300)] + [(1000 + i, "same words here") for i in range(400)] + [(5000, "long " * 9000)]
    for df in (docs(rows).repartition(7), odd):
        for capacity in (2048, 50):
            got = [r.asDict() for r in packing.pack(df, capacity=capacity).collect()]
            texts = Counter((r["doc_id"], r["text"] or "") for r in df.collect())
            want = Counter()
            for (doc, text), times in texts.items():
                ids = [*tokenizer(text), 0]
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                    want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += times
            assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
            sequences = defaultdict(list)
            for r in got:
                sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            for own in sequences.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(sequences) == len(one_by_one([r["length"] for r in got], capacity))


def test_nothing_to_pack(empty):
    assert packing.pack(empty).collect() == []


# --- search ---


def ranked(docs, items, k=20):
    own = [(doc, [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for doc, text in docs]
    own = [(doc, Counter(terms), len(terms)) for doc, terms in own if terms]
    total, df = sum(n for _, _, n in own), Counter(t for _, c, _ in own for t in c)
    out = Counter()
    for item, text in items:
        asked = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        found = []
        for doc, terms, n in own:
            m = 75 + 25 * n * len(own) // total
            score = sum(searching.weight_of(len(own), df[t]) * (1_000_000_000 * terms[t] // (1000 * terms[t] + 12 * m)) for t in asked if t in terms)
            if score > 0:
                found.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


@pytest.mark.parametrize(("shard", "block", "together"), [(8192, 128, 1024), (50, 4, 3), (7, 1, 1024)])
def test_ranks_equal_brute_force(spark, docs, odd, prose, monkeypatch, shard, block, together):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("TOGETHER", together)):
        monkeypatch.setattr(searching, name, value)
    r = random.Random(shard)
    rows = [(i, prose(r.choice([3, 30, 200]), i)) for i in range(300)] + [(1000 + i, "one two three copies of copies") for i in range(150)] + [(900, "Ünï C-3PO x_y"), (901, "ünï c 3po"), (None, "one two three copies of copies"), (902, None), (903, "..."), (1000, "one two three copies of copies")]
    df = docs(rows).unionByName(odd).repartition(5)
    items = [(i, prose(r.choice([1, 4, 25]), 1000 + i)) for i in range(20)] + [(50, "copies of one TWO"), (51, None), (52, ""), (53, "nowhere"), (54, "the the the of"), (54, "ünï Ü"), (None, "3PO"), (55, rows[7][1])]
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as item", "'x' as term", "'x' as block", "'x' as rank")
    for part in (df, df.limit(1).where("1 = 0")):
        got = Counter(tuple(x) for x in searching.search(searching.index(part), queries).collect())
        assert got == ranked([(x["doc_id"], x["text"]) for x in part.collect()], items)


def test_numbers_are_packed_whole():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1])
    data, ends = searching.pack(values)
    assert ends.tolist() == [1, 2, 3, 5, 7, 10, 13, 17, 22, 27]
    assert searching.unpack(data).tolist() == values.tolist()


def test_few_blocks_are_opened(docs, prose, monkeypatch):
    """A frequent word beside a rare one: documents are found by the rare one, and the frequent list isn't read whole."""
    monkeypatch.setattr(searching, "BLOCK", 16)
    opened = []
    monkeypatch.setattr(searching, "unpack", lambda data, f=searching.unpack: opened.append(len(data)) or f(data))
    shard = searching.Shard()
    for i in range(4000):
        shard.add(i, "common " * (1 + i % 3) + ("rare rare" if i % 400 == 0 else "filler"))
    head, *lists = [r for b in shard.rows(0) for r in b.to_pylist()]
    n, total = 4000, sum(head["lengths"])
    postings = {r["term"]: searching.Postings(r, searching.weight_of(n, r["df"]), lambda tf, length: 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * length * n // total))) for r in lists}
    query, lengths = [(1, postings[b"rare"]), (1, postings[b"common"])], np.array(head["lengths"])
    scores = np.zeros(n, np.int64)
    for _, p in query:
        docs_of, own = p.whole(lengths)
        scores[docs_of] += own
        p.all = None
    best = searching.Best(5)
    best.take(np.full(5, postings[b"common"].bound + 1), np.zeros(5, bool), np.arange(5) + 10_000)
    opened.clear()
    searching.best_of_shard(query, best, lengths, np.zeros(n, bool), np.arange(n))
    assert sum(opened) < 0.2 * len(postings[b"common"].row["postings"])
    assert best.rows[2].tolist() == np.lexsort((np.arange(n), -scores))[:5].tolist()
