"""Operators over whole tables: URL graph, SimHash, shards, mixing, quality, the pipeline."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditloom.llm import op2_urls, op3_simhash, op4_sharding, op5_quality, op6_mixing, shared

# --- URLs ---


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n", "'x' as host", "'y' as salt")

    return make


def test_hosts_paths_and_rules(pages):
    urls = ["http://A.Example.NET/en/1?q#f", "https://example.com/de/x", "http://org/fr/", "http://xorg/fr/", "net", None, "http://net?x=/y", "s3://b.net/x\ny?z", "http://fr.org/fr/a#b", "x://example.net/en", "a://b://c.net/en/"]
    rows = {r["page_id"]: r for r in op2_urls.judge(pages([(i, u, None) for i, u in enumerate(urls)])).collect()}
    assert [rows[i]["host"] for i in range(11)] == ["a.example.net", "example.com", "org", "xorg", "", "", "net", "b.net", "fr.org", "example.net", "b:"]
    assert [rows[i]["path"] for i in range(11)] == ["/en/1", "/de/x", "/fr/", "/fr/", "", "", "", "/x\ny", "/fr/a", "/en", "//c.net/en/"]
    assert [rows[i]["rule"] for i in range(11)] == ["example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, "net/", "org/fr/", "net/", None]
    assert [rows[i]["verdict"] for i in (0, 1, 2, 7)] == ["allow", "block", "allow", "block"]


def test_distrust_flows_to_hosts_that_link_to_blocked_ones(pages):
    blocked = [(i, "http://bad.net/x", None) for i in range(40)]
    friend = [(100 + i, "http://friend.test/a", '<a href="http://bad.net/1">') for i in range(4)]
    good = [(200 + i, "http://fine.test/a", '<a href="//ok.org/fr/1">') for i in range(4)] + [(300 + i, "http://ok.org/fr/1", None) for i in range(40)]
    rows = {r["page_id"]: r["verdict"] for r in op2_urls.judge(pages(blocked + friend + good)).collect()}
    assert {rows[100 + i] for i in range(4)} == {"block"} and {rows[200 + i] for i in range(4)} == {"allow"}


def test_propagation_equals_the_settled_ranks(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "a", 3.0), ("c", "d", 1.0), ("c", "e", 1.0), ("p", "q", 1.0), ("q", "p", 1.0)]
    seeds = [("a", 3.0), ("z", 1.0), ("p", 12.0)]
    frames = [[("one", *x) for x in edges] + [("other", "a", "z", 1.0)], [("one", *x) for x in seeds] + [("other", "a", 8.0)]]
    got = {(r["kind"], r["host"]): r["score"] for r in op2_urls.propagate(spark.createDataFrame(frames[0], "kind string, src string, dst string, w double"), spark.createDataFrame(frames[1], "kind string, host string, seed double")).collect()}
    names = ["a", "b", "c", "d", "e", "z", "p", "q"]
    move = np.zeros((8, 8))
    for s, d, w in edges:
        move[names.index(d), names.index(s)] = w / sum(x for a, _, x in edges if a == s)
    for end in ("e", "z"):
        move[names.index(end), names.index(end)] = 1
    seed = np.array([dict(seeds).get(n, 0.0) for n in names])
    want = np.linalg.solve(np.eye(8) - op2_urls.DAMPING * move, (1 - op2_urls.DAMPING) * seed)
    assert {k[1]: v for k, v in got.items() if k[0] == "one"} == pytest.approx(dict(zip(names, want, strict=True)), abs=op2_urls.TOLERANCE)
    assert {k[1]: v for k, v in got.items() if k[0] == "other"} == pytest.approx({"a": 4.0, "z": 4.0}, abs=op2_urls.TOLERANCE)


def test_scores_reach_hosts_that_are_many_links_away_and_ancestors_without_pages(pages):
    chain = [(i, f"http://h{i}.test/a", f'<a href="http://h{i + 1}.test/1">') for i in range(12)] + [(50 + i, "http://h12.test/", '<a href="//bad.net/">') for i in range(2)]
    rows = {r["page_id"]: r for r in op2_urls.judge(pages(chain + [(100 + i, "http://bad.net/x", None) for i in range(3000)])).collect()}
    assert all(0 < rows[i]["distrust"] < rows[i + 1]["distrust"] for i in range(1, 11)) and rows[0]["distrust"] > 0
    site = [(1, "http://example.com/de/x", None), (2, "http://a.b.c.example.com/", None), (3, "http://other.test/", None)]
    rows = {r["page_id"]: r for r in op2_urls.judge(pages(site)).collect()}
    assert rows[2]["distrust"] > 0 and rows[3]["distrust"] == 0


def test_very_long_urls_and_pages(pages):
    long = [(1, "http://a.net/" + "x" * 200_000 + "?q", None), (2, "http://" + "h." * 500 + "test/p", "<p>" * 200_000 + '<a href="//b.net/">'), (3, "http://b.net/", None)]
    rows = {r["page_id"]: r for r in op2_urls.judge(pages(long)).collect()}
    assert len(rows[1]["path"]) == 200_001 and rows[1]["rule"] == "net/" and rows[2]["distrust"] > 0


def test_urls_equal_the_sql(spark, pages, tmp_path):
    import duckdb

    made = [(i, u, h) for i, (u, h) in enumerate([("http://bad.net/x", None)] * 9 + [("http://friend.test/a", '<a href="http://bad.net/1"><img src=//c.d.org/2>')] * 3 + [("http://A.b.ok.org/fr/1", "<a href='http://friend.test/'>")] * 5 + [("http://b.ok.org/x", None), (None, None), ("x", "")] * 2)]
    given = spark.createDataFrame(made, "page_id long, url string, html string")
    for name, frame in (("hand", given), ("table", spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))):
        frame.write.parquet(f"{tmp_path}/{name}")
        c = duckdb.connect()
        c.execute(f"create view pages as select * from '{tmp_path}/{name}/*.parquet'")
        want = c.execute(op2_urls.ORACLE_SQL["op2_url_graph"]).df()[["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]]
        got = op2_urls.judge(frame).toPandas()
        assert sorted(map(str, want.astype(object).where(want.notna(), None).values.tolist())) == sorted(map(str, got.astype(object).where(got.notna(), None).values.tolist()))


def test_pages_without_rows_or_links(pages):
    assert op2_urls.judge(pages([(1, "x", None)]).limit(0)).count() == 0
    assert op2_urls.judge(pages([(None, None, None), (None, None, None)])).count() == 2


# --- SimHash ---


def brute_fp(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_groups(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_groups_equal_brute_force(docs, prose, odd):
    texts = [prose(60, i % 40) + (" extra" if i % 3 else "") + (" word" if i % 5 == 0 else "") for i in range(160)]
    rows = {r["doc_id"]: r for r in op3_simhash.groups(docs(list(enumerate(texts)))).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [rows[i]["fingerprint"] for i in range(160)] == [f"{x:016x}" for x in fps]
    assert [rows[i]["component_id"] for i in range(160)] == brute_groups(fps)
    found = op3_simhash.groups(odd).collect()
    assert len(found) == odd.count()
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 9, 11)} == {1} and {r["component_id"] for r in found if r["doc_id"] in (5, 6)} == {5}


def test_more_views_link_more_near_copies(docs, prose):
    r = random.Random(11)
    rows = []
    for i in range(40):
        words = prose(220, i).split()
        other = list(words)
        for k in r.sample(range(len(other)), 2):
            other[k] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    one = {x["doc_id"]: x["component_id"] for x in op3_simhash.groups(docs(rows)).collect()}
    four = {x["doc_id"]: x["component_id"] for x in op3_simhash.groups(docs(rows), views=4).collect()}
    caught = [sum(g[2 * i + 1] == 2 * i for i in range(40)) for g in (one, four)]
    assert caught[1] > caught[0] and caught[1] >= 30
    fps = [op3_simhash.fingerprint(t, views=4) for _, t in rows]
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(80):
        for j in range(i):
            if any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [four[i] for i in range(80)] == [find(i) for i in range(80)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("gathered", [4096, 4])
def test_links_lose_no_pair(spark, gathered, monkeypatch):
    monkeypatch.setattr(op3_simhash, "GATHERED", gathered)
    r = random.Random(7)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:12]:
        for d in (1, 2, 3, 3, 3, 4):
            y = x
            for b in r.sample(range(64), d):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in op3_simhash.links(table).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    at = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        lo, hi = sorted((find(at[a]), find(at[b])))
        root[hi] = lo
    assert [find(i) for i in range(len(fps))] == brute_groups(fps)


def test_some_chain_start_holds_for_every_pair_within_the_budget():
    ring, r = op3_simhash.Ring(), random.Random(5)
    for _ in range(2000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        met = False
        for s in range(ring.segments):
            d = op3_simhash._turn(np.array([x ^ y], np.uint64), s * ring.width)
            met |= len(ring.chain(d)) > 0 and any(not int(d[0]) & ring.key_mask(h) for h in (0, 1))
        assert met


def test_components_reach_their_least_node(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(2, 41)} == {1} and got[101] == got[102] == 100 and 200 not in got
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- shards ---


def test_shards_are_even_gapless_and_repeatable(docs, odd, empty):
    for frame in (docs([(i, f"text {i}") for i in range(997)]), odd):
        rows = op4_sharding.shards(frame).collect()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(by.get(s, [])) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        again = op4_sharding.shards(frame.repartition(7)).collect()
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["shard"], r["slot"])
        assert sorted(map(tuple, sorted(rows, key=key)), key=str) == sorted(map(tuple, sorted(again, key=key)), key=str)
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id is not null").collect()}
    for r in op4_sharding.shards(odd.where("doc_id is not null")).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert op4_sharding.shards(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1001])
def test_feistel_walk_is_a_permutation(spark, n):
    got = spark.range(n).select(op4_sharding.permuted(F.col("id"), F.lit(n).cast("long"), 9).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


# --- mixing ---


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    active, budget = set(sizes), 1.5 * sum(sizes.values())
    while active:
        left = budget - sum(2 * sizes[s] for s in sizes if s not in active)
        over = {s for s in active if left * weight[s] / sum(weight[a] for a in active) > 2 * sizes[s]}
        if not over:
            return {s: left * weight[s] / sum(weight[a] for a in active) if s in active else 2.0 * sizes[s] for s in sizes}
        active -= over
    return {s: 2.0 * n for s, n in sizes.items()}


def test_mix_meets_targets(docs, prose, odd):
    r = random.Random(4)
    rows = [(i, prose(r.choice([1, 3, 7, 20, 90, 90, 90]), i), "en", r.choice(["a", "b", "c", "d", "é", None])) for i in range(600)] + [(700 + i, "same words here", "en", "a") for i in range(300)]
    made = docs(rows)
    for frame in (made, odd):
        out = op6_mixing.mix(frame).collect()
        assert len(out) == frame.count()
        source = {(d["doc_id"], op): d["source"] for d in frame.collect() for op in [0]}
        sizes, taken, target = {}, {}, {}
        for x in out:
            s = source[x["doc_id"], 0]
            sizes[s] = sizes.get(s, 0) + x["size"]
            taken[s] = taken.get(s, 0) + x["taken"]
            target[s] = x["target"]
            assert 0 <= x["taken"] <= 2 * x["size"]
        assert target == pytest.approx(brute_targets(sizes))
        assert frame is not made or all(abs(taken[s] - target[s]) <= 1.01 for s in sizes)
        again = op6_mixing.mix(frame.repartition(5)).collect()
        assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_rows_keep_their_columns(docs, empty):
    frame = docs([(i, "w " * (i + 1), "en", "ab"[i % 2]) for i in range(30)])
    taken = {x["doc_id"]: x["copies"] for x in op6_mixing.mix(frame).collect()}
    out = op6_mixing.mixed(frame)
    assert out.columns == frame.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}
    assert op6_mixing.mix(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_knapsack_is_exact_on_small_budgets(seed):
    r = np.random.default_rng(seed)
    lengths, counts = np.unique(r.integers(1, 60, 12)), None
    counts = r.integers(1, 4, len(lengths))
    budget = int(r.integers(1, int((lengths * counts).sum()) + 1))
    take = op6_mixing.fit(lengths, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    share = np.minimum(counts, (counts * min(1.0, budget / (lengths * counts).sum())).astype(int))
    sums = {int((share * lengths).sum())}
    for length, free in zip(lengths, counts - share, strict=True):
        sums = {s + int(k * length) for s in sums for k in range(int(free) + 1)}
    assert abs(int((take * lengths).sum()) - budget) <= min(abs(s - budget) for s in sums)


def test_the_part_that_is_filled_greedily_costs_little(monkeypatch):
    monkeypatch.setattr(op6_mixing, "FIT", 64)
    r, missed = np.random.default_rng(5), []
    for _ in range(200):
        lengths = np.unique(r.integers(1, 32, r.integers(3, 40)))
        counts = r.integers(1, 20, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(r.integers(1, total + 1))
        reach = 1
        for length, free in zip(lengths.tolist(), counts.tolist(), strict=True):
            for _ in range(free):
                reach |= reach << length
        best = next(d for d in range(total + 1) if budget >= d and reach >> (budget - d) & 1 or reach >> (budget + d) & 1)
        missed.append(abs(int((op6_mixing.fit(lengths, counts, budget) * lengths).sum()) - budget) - best)
    assert min(missed) >= 0 and max(missed) <= 23 and sum(x > 0 for x in missed) <= 20


def test_long_documents_fit_as_near_as_they_can():
    take = op6_mixing.fit(np.array([100_000, 300_000]), np.array([3, 1]), 290_000)
    assert take.tolist() in ([0, 1], [3, 0])
    assert op6_mixing.fit(np.array([10]), np.array([1]), 4).tolist() == [0]
    assert op6_mixing.fit(np.array([10]), np.array([1]), 9).tolist() == [1]


# --- quality ---


@pytest.fixture
def labelled(spark, docs, prose):
    bad = lambda i: " ".join(w.upper() + "!!" for w in prose(25, i).split()) if i % 2 else " | ".join(prose(25, i).split()) + " ***"
    rows = [(i, bad(i) if i % 5 == 0 else prose(60, i), "en", f"s{i % 4}") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 500, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs(rows), labels


def test_quality_is_learned_and_the_same_each_time(labelled):
    frame, labels = labelled
    model = op5_quality.train(frame, labels)
    rows = {r["doc_id"]: r for r in op5_quality.score(frame, model).collect()}
    unseen = [i for i in range(500) if i % 2]
    assert np.mean([rows[i]["accepted"] == (i % 5 != 0) for i in unseen]) > 0.97
    again = op5_quality.train(frame.repartition(6), labels)
    assert np.allclose(model.joint, again.joint) and np.allclose(model.beta[0], again.beta[0])
    kept = op5_quality.accept(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["accepted"]}


def test_quality_without_labels_accepts_all(labelled, odd, empty):
    model = op5_quality.train(odd, labelled[1].limit(0))
    rows = op5_quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r["accepted"] and r["score"] == 1 for r in rows)
    good = op5_quality.train(*labelled)
    assert op5_quality.score(odd, good).count() == odd.count() and op5_quality.score(empty, good).count() == 0


def test_co_training_equals_plain_numpy_over_all_unlabelled_documents(labelled, monkeypatch):
    monkeypatch.setattr(op5_quality, "EXCHANGED", 20)
    monkeypatch.setattr(op5_quality, "SURE", 0.8)
    frame, labels = labelled
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] in (0, 1)}
    rows = frame.collect()
    see = lambda r: np.concatenate([op5_quality.content_view(r["text"] or ""), op5_quality.metadata_view(r["source"], r["lang"], r["n_chars"])]).astype(np.float32).astype(np.float64)
    x, y = np.array([see(r) for r in rows if r["doc_id"] in truth]), np.array([truth[r["doc_id"]] for r in rows if r["doc_id"] in truth])
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order]
    pool = np.unique(np.array([see(r) for r in rows if r["doc_id"] not in truth]), axis=0)
    mean, spread, hold = x.mean(axis=0), x.std(axis=0) + 1e-3, np.arange(len(y)) % 4 == 0
    fit = lambda own: [op5_quality.fit_logistic(a[:, v], b, w) for (a, b, w), v in zip(own, op5_quality.VIEWS, strict=True)]
    own, free = [((x[~hold] - mean) / spread, y[~hold], np.ones((~hold).sum()))] * 2, [np.ones(len(pool), bool) for _ in range(2)]
    beta, exchanged = fit(own), 0
    for _ in range(op5_quality.ROUNDS):
        given = []
        for learner in (0, 1):
            v = op5_quality.VIEWS[1 - learner]
            p = 1 / (1 + np.exp(-(((pool - mean) / spread)[:, v] @ beta[1 - learner][:-1] + beta[1 - learner][-1])))
            for label, sure in ((0, 1 - p), (1, p)):
                given.append((learner, label, sorted(np.flatnonzero(free[learner] & (sure >= 0.8)), key=lambda i: -sure[i])[:20]))
        for learner, label, best in given:
            free[learner][best] = False
            a, b, w = own[learner]
            own[learner] = np.concatenate([a, (pool[best] - mean) / spread]), np.concatenate([b, np.full(len(best), label)]), np.concatenate([w, np.full(len(best), op5_quality.WEIGHT)])
            exchanged += len(best)
        beta = fit(own)
    model = op5_quality.train(frame, labels)
    assert exchanged > 60
    for got, want in zip(model.beta, beta, strict=True):
        assert np.allclose(got, want, atol=0.02)


def test_views_of_long_texts_go_in_blocks(monkeypatch, prose):
    text = prose(500, 3)
    whole = op5_quality.content_view(text)
    monkeypatch.setattr(op5_quality, "BLOCK", 64)
    assert np.allclose(op5_quality.content_view(text), whole)


# --- pipeline ---


def test_pipeline_equals_its_stages_by_brute_force(spark, docs, labelled, tmp_path, prose):
    import re

    import corpus_pipeline

    frame, labels = labelled
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    extra = docs([(600 + i, prose(60, 1), "en", "s1") for i in range(20)] + [(700, "token = abcdef123456 " + prose(58, 7700), "en", "s2")])
    all_docs = frame.select(columns).unionByName(extra.select(columns))
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    texts = {r["doc_id"]: r for r in all_docs.collect()}
    accepted = {r["doc_id"] for r in op5_quality.score(all_docs, op5_quality.train(all_docs, labels)).where("accepted").collect()}
    ids = sorted(accepted)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (texts[i]["text"].lower().split() for i in ids)]
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    kept = sorted({ids[g] for g in root})
    assert 700 in kept
    assert not {*range(600, 620)} & {*kept}
    clean = {i: re.sub("token = abcdef123456", "token = [SECRET]", texts[i]["text"]) for i in kept}
    sizes = {}
    for i in kept:
        sizes[texts[i]["source"]] = sizes.get(texts[i]["source"], 0) + len(clean[i].split())
    want, words = brute_targets(sizes), {}
    counts = {}
    for r in out:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    for i, n in counts.items():
        assert i in clean and n <= 2
        words[texts[i]["source"]] = words.get(texts[i]["source"], 0) + n * len(clean[i].split())
    assert all(abs(words[s] - want[s]) <= 30.5 for s in sizes)  # nearly all documents have 60 words
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256(clean[r["doc_id"]].encode()).hexdigest() for r in out)


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (odd, empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, shared.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == frame.columns, name
            if name in ("quality", "secrets"):  # without labels all are accepted; secrets change texts, not rows
                assert docs.count() == before.count()
            if name == "near_duplicates":  # texts without words are copies of each other
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ([] if frame is empty else ["1", "10", "3", "4", "5", "7", "8", "None"])
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(out) == docs.count() and (frame is not empty or not out)


def test_mixed_rows_keep_columns_of_any_name(docs, prose):
    frame = docs([(i, prose(20, i), "en", "s") for i in range(20)]).selectExpr("*", "'c' as _copies", "'r' as _row", "'k' as copies", "'q' as quota")
    rows = op6_mixing.mixed(frame).collect()
    assert rows and rows[0].asDict().keys() == dict.fromkeys(frame.columns).keys()
    assert {(r["_copies"], r["_row"], r["copies"], r["quota"]) for r in rows} == {("c", "r", "k", "q")}


def test_many_equal_rows_are_counted_and_dealt_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(op4_sharding, "CHUNK", 7)
    frame = docs([(None, "same")] * 50 + [(i, "x") for i in range(30)] + [(5, "x")] * 3)
    rows = op4_sharding.shards(frame, n=4).collect()
    assert len(rows) == 83 and sum(r["doc_id"] is None for r in rows) == 50 and sum(r["doc_id"] == 5 for r in rows) == 4
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {20, 21}


def python_feistel(row, rows, seed):
    """The permutation in plain Python, its keyed hashes by another implementation of XXH64."""
    import math
    import struct

    def keyed(value, k):  # Spark hashes the long, then the int with that as its seed
        h = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
        return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", seed + k), h)))[0]

    wide = max(1, math.ceil(math.sqrt(rows)))
    high = (rows + wide - 1) // wide

    def step(x):
        right, left = divmod(x, wide)
        for k in range(op4_sharding.ROUNDS):
            if k % 2:
                right = (right + keyed(left, k) % high) % high
            else:
                left = (left + keyed(right, k) % wide) % wide
        return left + right * wide

    at = step(row)
    while at >= rows:
        at = step(at)
    return at


@pytest.mark.parametrize("rows", [1, 2, 7, 50, 997])
def test_permutation_equals_plain_python(spark, rows):
    got = spark.range(rows).select("id", op4_sharding.permuted(F.col("id"), F.lit(rows).cast("long"), op4_sharding.SEED).alias("at")).collect()
    assert {r["id"]: r["at"] for r in got} == {i: python_feistel(i, rows, op4_sharding.SEED) for i in range(rows)}
