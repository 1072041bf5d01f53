from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlane.llm import periodic_runs as p
from leadlane.llm.queries import op11_periodic_runs, repeat_planted_words

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def plain_runs(words):
    """Every longest stretch per period, smallest periods only."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if length >= max(6, 4 * q):
                stretch = words[a : a + length]
                if not any(stretch[s:] == stretch[:-s] for s in range(1, q)):
                    found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def runs_of(texts):
    return [[tuple(r) for r in runs.tolist()] for runs in p.runs_of_texts(pa.array(texts, pa.string()))[2]]


def test_wavelet_tree_answers_as_a_sorted_list():
    rng = np.random.default_rng(3)
    values = rng.permutation(777)
    tree = p.WaveletTree(values)
    low = rng.integers(0, 776, 400)
    high = low + 1 + (rng.random(400) * (777 - low - 1)).astype(int)
    at = np.array([rng.choice(values[a:b]) for a, b in zip(low, high)])
    smaller, larger = tree.neighbours(low, high, at)
    for a, b, x, s, g in zip(low, high, at, smaller, larger):
        part = values[a:b]
        assert s == max(part[part < x], default=-1) and g == min(part[part > x], default=-1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=6))
def test_runs_of_small_alphabets(texts):
    assert runs_of([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(4, 9), st.integers(0, 50), st.integers(0, 50), st.integers(1, 5), st.randoms(use_true_random=False))
def test_planted_runs(period, times, lead, tail, letters, rng):
    pick = lambda n: [rng.choice("abcdefgh"[:letters]) for _ in range(n)]
    unit = pick(period)
    words = pick(lead) + (unit * times)[: period * times - rng.randrange(period)] + pick(tail)
    assert runs_of([" ".join(words), "x " * 30, " ".join(words)]) == [plain_runs(words), [(0, 30, 1)], plain_runs(words)]


def test_long_texts():
    rng = random.Random(5)
    unit = [f"w{rng.randrange(5000)}" for _ in range(7001)]
    words = unit * 5 + ["end"] + ["a", "b"] * 20000 + unit
    assert runs_of([" ".join(words)]) == [[(0, 35005, 7001), (35006, 40000, 2)]]
    assert runs_of(["z " * 200_000]) == [[(0, 200_000, 1)]]


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a a a a a"), (5, "a a a a a a"), (6, "a b " * 6), (7, "x y\tx\ny  x y x y z"), (None, "q " * 7), (None, "q " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS Runs", "3 AS `a.b`")
    found = {}
    for r in p.find_runs(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert found == {
        1: [(0, [], "")], 2: [(0, [], "")], 3: [(0, [], "")],
        4: [(5, [], "a a a a a")], 5: [(6, [(0, 6, 1)], "a")], 6: [(6, [(0, 6, 1)], "a b")],
        7: [(9, [(0, 8, 2)], "x y z")], None: [(7, [(0, 7, 1)], "q")] * 2,
    }
    assert p.find_runs(docs.limit(0)).collect() == []
    texts = docs.selectExpr("cast(doc_id AS string) AS name", "text AS body")
    assert p.find_runs(texts, "name", "body").count() == len(rows)
    with pytest.raises(ValueError):
        p.find_runs(docs, least_periods=3)
    few = p.find_runs(docs, least_words=7, least_periods=5)
    assert {r["doc_id"] for r in few.collect() if r["runs"]} == {None}


def planted(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]


def test_query_agrees_with_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in op11_periodic_runs(spark, SF).collect()}
    assert len(rows) == len(docs)
    some = 0
    for doc, text in docs:
        words = planted(doc, split(text))
        if len(words) > 4000:
            continue
        runs = plain_runs(words)
        some += bool(runs)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        expected = (doc, len(runs), *best, runs and 1000 * best[1] // best[2] or None)
        expected += tuple(hashlib.sha256(t.encode()).hexdigest() for t in (lines, plain_collapsed(words, runs)))
        assert tuple(rows[doc]) == expected
    assert some > 5


def test_planting_in_all_kinds_of_rows(spark):
    texts = [None, "", "one", "a b c d e f g h i j k l m n o p q r s t", "x\ty  z"]
    docs = [(k, t) for k in [*range(-3, 60), None] for t in texts]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = [(r["doc_id"], split(r["text"])) for r in repeat_planted_words(table).collect()]
    expected = [(k, planted(k, split(t))) for k, t in docs]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(out, key=key) == sorted(expected, key=key)
