from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadlane.llm import neural_lm as lm

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
UP = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)), None]


def plain(docs):
    """{doc_id: (held out, tokens, known, base score)} and the number of training tokens."""
    out_of = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter(t for d, text in docs if not out_of[d] for t in tokens(text))
    total, size = sum(counts.values()), len(counts)
    rows = []
    for d, text in docs:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + size + 1)) for t in ts)
        rows.append((d, out_of[d], len(ts), sum(counts[t] > 0 for t in ts), base))
    return rows, total


def check(rows, docs):
    expected, total = plain(docs)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[4])
    found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in rows]
    for f, e in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert f[:4] == e[:4] and f[4] == pytest.approx(e[4], rel=1e-9, abs=1e-9)
    assert {r["train_tokens"] for r in rows} <= {total}


def test_query(spark):
    from leadlane.llm.queries import op5_neural_lm

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = op5_neural_lm(spark, SF).collect()
    check(rows, docs)
    for part in (True, False):
        score, base = (sum(r[c] for r in rows if r["held_out"] == part) for c in ("score", "base_score"))
        assert base < score < 0


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    docs = [(k, "the Cat sat on THE mat \x0b\x0c and É é\t\n" * (k % 5)) for k in range(60)]
    docs += [(100, None), (101, ""), (102, " "), (None, "null id words"), (103, "x" * 4000), (103, "x" * 4000), (104, "w\xa0w " * 9000)]
    table = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS score", "2 AS units", "'x' AS held_out")
    model = lm.LanguageModel(table.repartition(3), lm.held_out(F.col("doc_id")))
    check(model.score().collect(), docs)
    nothing = lm.LanguageModel(table.limit(0), lm.held_out(F.col("doc_id")))
    assert nothing.score().collect() == []
    unseen = lm.LanguageModel(table.filter("doc_id < 60"), F.lit(True)).score().collect()
    assert all(r["score"] == pytest.approx(0, abs=1e-6) and r["base_score"] == 0 and r["n_known"] == 0 for r in unseen)


def test_probabilities_sum_to_one(spark):
    docs = [(k, f"a b c d{k % 7} e a b {'z' * (k % 3)}") for k in range(80)]
    model = lm.LanguageModel(spark.createDataFrame(docs, SCHEMA), lm.held_out(F.col("doc_id")))
    valid = model.units.valid
    rng = np.random.default_rng(2)
    before = rng.choice(np.flatnonzero(valid), 6).astype(np.int32)
    total = 0.0
    for unit in np.flatnonzero(valid):
        sequence = np.append(before, unit).astype(np.int32)
        total += 10 ** lm.log10_units(model.parameters, valid, sequence, np.array([0]), [None])[-1]
    assert total == pytest.approx(1, abs=1e-5)
    # Within a unit, the words' shares are their counts plus one over the unit's mass.
    mass = np.zeros(lm.UNITS)
    for r in model._with_unit(model.words.filter("first AND c > 0"), model.frequent).collect():
        mass[r["unit"]] += r["c"] + 1
    mass[lm.END] = model.units.train_docs + 1
    assert np.allclose(mass, model.units.mass)


def test_contexts_stay_within_a_text():
    units = np.arange(10, 20, dtype=np.int32)
    got = lm.contexts_of(units, np.array([0, 3]))
    s = lm.START
    assert got[0].tolist() == [s] * 4 and got[2].tolist() == [11, 10, s, s]
    assert got[3].tolist() == [s] * 4 and got[9].tolist() == [18, 17, 16, 15]


def test_scores_equal_plain_log_softmax():
    rng = np.random.default_rng(3)
    units = rng.integers(0, lm.UNITS, 5000).astype(np.int32)
    starts = np.arange(0, 5000, 37)
    valid = np.ones(lm.UNITS, bool)
    valid[[5, 9]] = False
    units[~valid[units]] = 6
    for scale in (0.3, 3.0):  # the second has logits beyond the safe range
        p = lm.Parameters(rng.normal(0, scale, lm.Parameters.size()).astype(np.float32))
        contexts = lm.contexts_of(units, starts)
        q = sum(p.seen[contexts[:, k]].astype(float) * p.places[k] for k in range(lm.CONTEXT))
        assert np.allclose(p.predicted(contexts), q, atol=1e-4)
        logits = np.where(valid, q @ p.next.T.astype(float) + p.bias, -np.inf)
        assert np.abs(logits[:, valid]).max() <= p.largest_logit(q.astype(np.float32)) * (1 + 1e-5)
        assert (p.largest_logit(q.astype(np.float32)) > lm.SAFE_LOGIT) == (scale == 3.0)
        top = logits.max(axis=1, keepdims=True)
        expected = (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))[np.arange(5000), units] / np.log(10)
        found = lm.log10_units(p, valid, units, starts, [None] * len(starts))
        assert np.allclose(found, expected, rtol=1e-4, atol=1e-4)


def test_words_of_a_block_are_rows(monkeypatch):
    """Texts come as they are, and no later step has to take word lists apart."""
    monkeypatch.setattr(lm.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    columns = {"doc_id": pa.array([1, 2, None, 4]), "text": pa.array(["The cat THE", None, "Éa cat\x0b", " "]), "held_out": pa.array([False, True, False, True])}
    docs, words = lm._index(iter([pa.RecordBatch.from_pydict(columns), pa.RecordBatch.from_pydict(columns).slice(0, 0)]))
    assert docs.schema == words.schema and set(docs.column("block").to_pylist() + words.column("block").to_pylist()) == {3 << 24}
    assert docs.column("doc_id").to_pylist() == [1, 2, None, 4] and docs.column("word").null_count == 4
    assert [np.frombuffer(ids, "<u4").tolist() for ids in docs.column("ids").to_pylist()] == [[0, 1, 0], [], [2, 1], []]
    rows = zip(*(words.column(c).to_pylist() for c in ("word", "place", "n_train", "doc_id", "ids")))
    assert [*rows] == [("the", 0, 2, None, None), ("cat", 1, 2, None, None), ("Éa", 2, 1, None, None)]


def test_training_step_follows_the_plain_gradient():
    rng = np.random.default_rng(4)
    first = lm.Parameters(rng.normal(0, 0.3, lm.Parameters.size()).astype(np.float32))
    prior = rng.random(lm.UNITS)
    prior /= prior.sum()
    contexts = rng.integers(0, lm.UNITS + 1, (500, lm.CONTEXT))
    targets = rng.integers(0, lm.UNITS, 500)
    trainer = lm.Trainer(first, prior, 5)
    trainer.step(contexts, targets)

    noise = np.random.default_rng(5).choice(lm.UNITS, lm.NOISE, p=prior)
    p = lm.Parameters(first.flat.astype(float))
    g = lm.Parameters(np.zeros_like(p.flat))
    for context, target in zip(contexts, targets):
        q = sum(p.seen[u] * p.places[k] for k, u in enumerate(context))
        to_q = np.zeros(lm.DIMENSIONS)
        for unit, wanted in [(target, 1), *((u, 0) for u in noise)]:
            error = wanted - 1 / (1 + np.exp(-(q @ p.next[unit] + p.bias[unit] - np.log(lm.NOISE * prior[unit]))))
            to_q += error * p.next[unit]
            g.next[unit] += error * q
            g.bias[unit] += error
        for k, u in enumerate(context):
            g.places[k] += to_q * p.seen[u]
            g.seen[u] += to_q * p.places[k]
    mean = g.flat / 500
    assert np.allclose(trainer.p.flat, p.flat + lm.RATE * mean / np.sqrt(1e-3 + mean**2), atol=1e-5)


def test_contexts_of_short_texts():
    units = np.arange(10, 17, dtype=np.int32)
    starts = np.array([0, 1, 3])
    for k, row in enumerate(lm.contexts_of(units, starts).tolist()):
        first = starts[starts <= k].max()
        assert row == [units[k - 1 - j] if k - 1 - j >= first else lm.START for j in range(lm.CONTEXT)]
