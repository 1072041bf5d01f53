from __future__ import annotations

import brute
import pytest

from leadlane.llm import quality

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"

PLAIN = "the cat sat on the mat and then it went away to look for some milk " * 1
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "a b"), (6, "a b a b a b"), (7, "x\n\nx\n x\nx"),
    (8, "é ü # * $ % & | < >"), (9, "w " * 60), (10, " ".join(f"w{i}" for i in range(60))),
    (10, " ".join(f"w{i}" for i in range(60))), (None, " ".join(f"v{i}" for i in range(70))),
    (11, "one two three four one two three five " * 8), (12, "a b c x a b c y a b c"), (13, "q" * 5000),
    (14, " ".join(f"long{i % 977}" for i in range(9000))),
]


def check(rows, expected):
    def key(r):
        return tuple((r[c] is None, r[c]) for c in ("doc_id", "n_words", "word_chars"))

    rows, expected = sorted((r.asDict() for r in rows), key=key), sorted(expected, key=key)
    assert len(rows) == len(expected)
    for r, e in zip(rows, expected):
        margin = e.pop("margin")
        score = e.pop("score")
        assert (r["score"] is None) == (score is None)
        assert score is None or r.pop("score") == pytest.approx(score, abs=1e-9)
        r.pop("score", None)
        if margin is not None and abs(margin) < 1e-9:
            r.pop("kept"), e.pop("kept")
        assert r == e


def test_odd_rows_agree_with_a_plain_version(spark):
    labels = [(10, 1, 0), (14, 1, None), (11, 0, 0), (8, 1, 1), (None, 1, 0)]
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS h", "'x' AS score", "2 AS Text_2")
    out = quality.judge(docs, spark.createDataFrame(labels, LABELS))
    check(out.collect(), brute.quality_rows(ODD, labels, quality.BUCKETS, quality.SPREADS))


def test_the_query_agrees_with_a_plain_version(spark):
    from leadlane.llm.queries import op6_quality

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check(op6_quality(spark, sf).collect(), brute.quality_rows(docs, labels, quality.BUCKETS, quality.SPREADS))


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], LABELS)
    assert quality.judge(nothing, no_labels).collect() == []
    some = spark.createDataFrame([(1, " ".join(map(str, range(80))))], SCHEMA)
    assert [r["kept"] for r in quality.judge(some, no_labels).collect()] == [True]


def test_no_python_in_the_plan(spark):
    from leadlane.llm.queries import op6_quality

    plan = op6_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_trusted_document_counts(spark):
    """More trusted documents than any sample would hold; the filter of their ids lets all of them pass."""
    rows = [(i, f"w{i % 7} v{i % 11}") for i in range(21_000)] + [(None, "w0 x"), (3, "again y"), (50_000, "other z")]
    labels = [(i, 1, 0) for i in range(21_000)] + [(None, 1, 0), (50_000, 0, 0)]
    docs, trusted = spark.createDataFrame(rows, SCHEMA), quality.trusted_ids(spark.createDataFrame(labels, LABELS))
    assert trusted.count() == 21_000
    marked = quality.with_trust(docs, trusted, quality.Workspace(spark))
    found = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in marked.filter("is_trusted = 1").collect())
    assert found == sorted((False, i, t) for i, t in rows if i is not None and i < 21_000)
    assert marked.count() == len(rows)
    scored = spark.createDataFrame([(i, float(i)) for i in range(21_000)], "doc_id long, score double")
    assert quality.fit_threshold(scored, trusted) == pytest.approx(10499.5 - quality.SPREADS * (10499.5 - 1049.95))
    assert quality.fit_threshold(scored, trusted.limit(0)) is None
