from __future__ import annotations

import zlib

import numpy as np
import pytest

from leadlane.llm import langid

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def predicted(spark):
    from leadlane.llm.queries import op9_langid

    return op9_langid(spark, SF).collect()


def test_held_out_accuracy(spark, predicted):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(predicted) == len(truth)
    for r in predicted:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    unseen = [r for r in predicted if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in unseen]) > 0.97
    sure = [r["lang_pred"] == truth[r["doc_id"]] for r in unseen if r["score"] > 0.9]
    assert len(sure) > 0.8 * len(unseen) and np.mean(sure) > 0.97


def test_document_frequencies_count_every_row(spark):
    texts = ["ab", "abc", None, "zz", "ab", "É", ""]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    df, n = langid.document_frequencies(langid.labelled(rows))
    expected = np.zeros(langid.FEATURES, int)
    for t in texts:
        if t is not None:
            _, features, valid = langid._codes([t])
            expected[np.unique(np.concatenate([f[ok] for f, ok in zip(features, valid)]))] += 1
    assert n == 6 and (df == expected).all()


def test_texts_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(3)
    texts = ["", "a", "ab", "été", "x" * 3000, "Straße und Weg"]
    weights = rng.normal(size=(langid.FEATURES, 3)).astype(np.float32)
    model = langid.LanguageModel(["a", "b", "c"], weights, np.zeros(3))
    alone = np.concatenate([model.logits([t]) for t in texts])
    assert np.allclose(model.logits(texts), alone, atol=1e-5)


def test_odd_rows(spark):
    model = langid.LanguageModel(["a", "b"], np.zeros((langid.FEATURES, 2), np.float32), np.zeros(2))
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 ... \n", "a"), (None, "é", None), (5, "word", None), (5, "word", None), (6, "long " * 300_000, "a")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' AS score", "1 AS LANG_PRED")
    out = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert out == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "a", 0.5), (5, "a", 0.5), (6, "a", 0.5)}
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    nothing = docs.limit(0)
    assert langid.fit(nothing) is None
    assert langid.predict(nothing, None).collect() == []
