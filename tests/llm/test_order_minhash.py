from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from leadlane.llm import order_minhash as m
from leadlane.llm.components import components
from leadlane.sources.staging import Workspace

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        text[at : at + rng.randint(0, 1)] = ["new"] * rng.randint(0, 1)
    return text


def distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def plain_classes(docs):
    """Classes by aligning all pairs."""
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = {d: (t or "").lower().split() for d, t in docs}
    for d in texts:
        parent[d] = d
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = texts[a], texts[b]
            budget = int(0.2 * max(len(x), len(y)) + 1e-9)
            if abs(len(x) - len(y)) <= budget and root(a) != root(b) and distance(x, y) <= budget:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    docs, passage = [], words(rng, 30)
    for _ in range(12):
        text = words(rng, rng.randint(20, 90))
        if rng.random() < 0.5:
            text[5:5] = passage
        for _ in range(rng.randint(1, 4)):
            docs.append(" ".join(edited(rng, text, rng.randint(0, len(text) // 25))))
    docs += [docs[0], docs[0].upper(), None, "", " \n", "a", "a b", "A  b"]
    return list(enumerate(docs))


def test_agrees_with_aligning_all_pairs(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS class_id", "2 AS h1", "3 AS node")
    out = m.near_duplicate_classes(table).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == plain_classes(docs) and len(out) == len(docs)


def test_large_buckets_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 2)
    docs = corpus(4)
    out = m.near_duplicate_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == plain_classes(docs)


def test_odd_rows(spark):
    rng = random.Random(5)
    long = words(rng, 60_000)
    near = edited(rng, long, 300)
    docs = [(1, " ".join(long)), (2, " ".join(near)), (None, "x y z"), (None, "x y z"), (3, "x y z"), (3, "x y z"), (None, "only null")]
    out = m.near_duplicate_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    found = sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in out)
    assert found == [(-1, -1), (-1, 3), (-1, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert m.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()
    found = defaultdict(set)
    for r in out:
        found[r["root"]].add(r["node"])
    neighbours = defaultdict(set)
    for a, b in edges:
        if a != b:
            neighbours[a].add(b), neighbours[b].add(a)
    left, expected = set(neighbours), {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += neighbours[x]
        expected[min(group)] = group
        left -= group
    assert found == expected and len(out) == sum(map(len, expected.values()))


def test_shingles_number_repeats():
    word = np.array([5, 5, 5, 5, 5, 5, 5], np.uint64)
    assert len(set(m.shingles(word).tolist())) == 3
    assert len(m.shingles(word[:2])) == 1
    once = np.arange(1, 9, dtype=np.uint64)
    again = np.concatenate([once, once[:6]])
    assert set(m.shingles(once).tolist()) <= set(m.shingles(again).tolist()) and len(set(m.shingles(again).tolist())) == 10


def test_no_link_of_the_small_table_is_missed(spark):
    """All pairs of a thousand documents that a bag of words lets pass, aligned."""
    from leadlane.llm.alignment import distance_within
    from leadlane.llm.queries import op7_order_minhash

    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r["class_id"] for r in op7_order_minhash(spark, sf).collect()}
    docs = {r["doc_id"]: (r["text"] or "").lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    bags = np.zeros((len(ids), 512), np.int16)
    for i, d in enumerate(ids):
        for w in docs[d]:
            bags[i, hash(w) % 512] += 1
    n = np.array([len(docs[d]) for d in ids])
    links = missed = 0
    for i, a in enumerate(ids):
        gap = bags[i + 1 :] - bags[i]
        more = np.where(gap > 0, gap, 0).sum(axis=1)
        budget = np.floor(0.2 * np.maximum(n[i + 1 :], n[i]) + 1e-9)
        for j in np.flatnonzero(np.maximum(more, more - gap.sum(axis=1)) <= budget):
            b = ids[i + 1 + j]
            if distance_within(docs[a], docs[b], int(budget[j])) is not None:
                links, missed = links + 1, missed + (found[a] != found[b])
    assert links > 150 and missed <= links // 100


def substituted(rng, text, n):
    """``n`` words of a text replaced, at different places."""
    text = list(text)
    for at in rng.sample(range(len(text)), n):
        text[at] = f"new{rng.randrange(10**9)}"
    return text


def bucket_classes(docs):
    """Classes by aligning all pairs that share a sketch."""
    from xxhash import xxh64_intdigest

    texts = {d: t.lower().split() for d, t in docs}
    keys = {d: set(m.sketch(np.array([xxh64_intdigest(w, seed=42) for w in t], np.uint64)).tolist()) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            budget = int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9)
            if root(a) != root(b) and keys[a] & keys[b] and m._distance(" ".join(texts[a]), " ".join(texts[b]), 0.8) is not None:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in ids}


def chains(seed, n_chains, n_words=200, versions=8):
    rng = random.Random(seed)
    docs = []
    for k in range(n_chains):
        text = words(rng, n_words)
        for _ in range(versions):
            docs.append(" ".join(text))
            text = substituted(rng, text, int(n_words * rng.choice((0.1, 0.12, 0.15))))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_drifting_versions_keep_every_link_of_their_buckets(spark):
    docs = chains(21, 60)
    out = m.near_duplicate_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == bucket_classes(docs)


def test_large_buckets_keep_every_link(spark, monkeypatch):
    """Texts around one boilerplate passage, many pairs of which have a single sketch in common."""
    monkeypatch.setattr(m, "BUCKET_ROWS", 6)
    rng = random.Random(23)
    passage = " ".join(words(rng, 40))
    docs = [(d, f"{passage} {text}") for d, text in chains(22, 40, n_words=80, versions=3)]
    out = m.near_duplicate_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == bucket_classes(docs)


def test_recall_of_sketches_by_similarity():
    """Pairs with spread substitutions that have a sketch in common, down to the threshold itself."""
    rng = np.random.default_rng(24)
    for n in (20, 60, 61, 300):
        for percent, least in ((10, 0.995), (15, 0.985), (20, 0.96)):
            met, pairs = 0, 400
            for _ in range(pairs):
                one = rng.integers(1, 1 << 63, n, dtype=np.uint64)
                other = one.copy()
                at = rng.choice(n, n * percent // 100, replace=False)
                other[at] = rng.integers(1, 1 << 63, len(at), dtype=np.uint64)
                met += bool(set(m.sketch(one).tolist()) & set(m.sketch(other).tolist()))
            print(n, percent, met / pairs)
            assert met >= least * pairs, (n, percent, met / pairs)
