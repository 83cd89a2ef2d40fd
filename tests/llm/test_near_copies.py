"""Near copies by five-word shingles, and which row of a group stays."""

import random

import corpus_pipeline
import pytest

from auditloom.llm import near_copies


def brute_similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def brute_groups(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if brute_similarity(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


@pytest.fixture
def edited(prose):
    """Forty texts, each with a copy whose similarity is 0.8 to 0.9."""
    r, texts = random.Random(3), []
    for i in range(40):
        words = prose(220, i).split()
        other = list(words)
        while brute_similarity(" ".join(words), " ".join(other)) > 0.87:
            other[r.randrange(len(other))] = "changed"
        texts += [" ".join(words), " ".join(other)]
    return texts


def kept(spark, frame):
    return sorted((x["doc_id"] is None, x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, frame, "").collect())


def test_copies_of_similarity_0_8_are_found_and_others_stay(spark, docs, edited, prose):
    line = "the same line comes again and again here "
    alike = [line * 60 + prose(60, 900 + i) for i in range(6)]  # mostly one line, but other shingles
    texts = edited + alike
    root = brute_groups(texts)
    assert root[:80] == [i - i % 2 for i in range(80)] and len({*root[80:]}) == 6
    assert [x[1] for x in kept(spark, docs(list(enumerate(texts))))] == sorted({*root})


def test_wide_keys_lose_no_copy(spark, docs, edited, monkeypatch, prose):
    monkeypatch.setattr(near_copies, "FEW", 1)
    r, family = random.Random(5), []
    for _ in range(30):
        words = prose(220, 777).split()
        words[r.randrange(220)] = f"w{r.randrange(9)}"
        family.append(" ".join(words))
    texts = edited[:40] + family
    assert [x[1] for x in kept(spark, docs(list(enumerate(texts))))] == sorted({*brute_groups(texts)})


def test_null_and_repeated_ids_lose_no_text(spark, docs, prose):
    a, b, c, d, e, f = (prose(60, 300 + i) for i in range(6))
    frame = docs([(None, a), (None, b), (None, c), (5, c), (5, d), (5, e), (5, e), (9, e), (None, f), (None, f), (None, None), (None, " ")])
    found = corpus_pipeline.near_duplicates(spark, frame, "")
    assert found.columns == frame.columns
    rows = [(x["doc_id"], (x["text"] or "").strip()) for x in found.collect()]
    assert sorted(rows, key=str) == sorted([(None, a), (None, b), (5, c), (5, d), (5, e), (None, f), (None, "")], key=str)


def test_a_group_has_its_least_id_and_an_empty_table_no_rows(spark, docs, empty, prose):
    assert kept(spark, docs([(None, prose(60, 1)), (8, prose(60, 1).upper()), (7, prose(60, 1))])) == [(False, 7, prose(60, 1))]
    assert kept(spark, empty) == []


def family(seed, low, high, size=500, length=400):
    """Texts that differ from one text in ``low`` to ``high`` words each."""
    r = random.Random(seed)
    words = [f"w{seed}x{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        own = list(words)
        for at in r.sample(range(length), r.randint(low, high)):
            own[at] = f"c{r.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def groups_of(texts):
    """How many groups all pairs give, by a product of incidence matrices."""
    import numpy as np

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    columns = {x: i for i, x in enumerate(set().union(*sets))}
    there = np.zeros((len(texts), len(columns)), np.float32)
    for i, s in enumerate(sets):
        there[i, [columns[x] for x in s]] = 1
    common, sizes = there @ there.T, there.sum(axis=1)
    near = common / (sizes[:, None] + sizes[None, :] - common) >= 0.8
    root = np.arange(len(texts))
    while True:
        new = np.where(near, root[None, :], len(texts)).min(axis=1)
        if (new == root).all():
            return len({*root.tolist()})
        root = new


def test_wide_families_are_joined(spark, docs):
    """Of the copies that all pairs would remove, 0.99 go; and none else."""
    families = [family(1, 4, 8), family(2, 5, 7, size=300), family(3, 3, 19, size=300)]
    texts = [t for f in families for t in f]
    stay = [x[1] for x in kept(spark, docs(list(enumerate(texts))))]
    told, start = [], 0
    for f in families:
        told.append((len(f), groups_of(f), sum(start <= i < start + len(f) for i in stay)))
        start += len(f)
    assert all(groups <= left for _, groups, left in told), told
    assert sum(n - left for n, _, left in told) >= 0.99 * sum(n - groups for n, groups, _ in told), told


def test_wide_families_are_joined_as_all_pairs_join_them(spark, docs, monkeypatch):
    """Members that are like very few of their family, in tiles of many keys."""
    monkeypatch.setattr(near_copies, "TILE", 60)
    families = [family(4, 5, 7, size=400), family(3, 3, 19, size=300)]
    texts = [t for f in families for t in f]
    assert len(kept(spark, docs(list(enumerate(texts))))) == sum(map(groups_of, families))
