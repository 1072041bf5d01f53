from __future__ import annotations

import zlib
from collections import Counter

import brute
import numpy as np
from test_line_chunks import plain_with_runs

import corpus_pipeline
from leadlane.llm import decontaminate, packing, quality
from leadlane.llm.alignment import best_within, distance_within
from leadlane.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def first_of_classes(docs):
    """Smallest ids of the classes, by comparing all pairs."""
    words = {d: t.lower().split() for d, t in docs}
    parent = {d: d for d in words}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    bags = {d: Counter(w) for d, w in words.items()}
    for a in words:
        for b in words:
            if a >= b or root(a) == root(b):
                continue
            budget = int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)
            if max((bags[a] - bags[b]).total(), (bags[b] - bags[a]).total()) <= budget:
                if distance_within(words[a], words[b], budget) is not None:
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {root(d) for d in words}


def without_passages(docs, items):
    windows = decontaminate.Windows([(i, decontaminate.normalise(t)) for i, t in items])
    checks = list(zip(windows.texts, windows.budgets.tolist()))
    return [d for d in docs if not any(best_within(p, decontaminate.normalise(d[1]), n) for p, n in checks)]


def test_agrees_with_a_plain_version(spark):
    from tokenizers import Tokenizer

    def table(name, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]

    docs = table("documents", "doc_id", "text")
    verdicts = brute.quality_rows(docs, table("labels", "doc_id", "quality", "toxic"), quality.BUCKETS, quality.SPREADS)
    kept = {r["doc_id"] for r in verdicts if r["kept"]}
    docs = [d for d in docs if d[0] in kept]
    docs = [d for d in plain_with_runs(docs) if d[1].strip()]
    first = first_of_classes(docs)
    docs = [d for d in docs if d[0] in first]
    docs = without_passages(docs, table("benchmark", "item_id", "text"))
    model = Tokenizer.from_file(tokenizer_path(packing.WORD_TOKENIZER))
    expected = Counter()
    for doc, text in docs:
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        for k, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[a : a + packing.CAPACITY]
            expected[doc, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= packing.CAPACITY and 50 < len(docs) < 190


def odd_documents(spark):
    rows = [(1, None, "en"), (2, "", None), (None, " ".join(f"w{k}" for k in range(90)), "en"), (3, " ".join(f"w{k}" for k in range(90)), "en")]
    rows += [(4, "\n".join(f"line {k} with words {k * 7} in it" for k in range(9000)), "x")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS h1", "2 AS kept", "'q' AS Chunks", "3 AS `a.b`")


def test_stages_return_the_columns_they_get(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        found = out.collect()
        assert len(found) <= docs.count()
        assert stage(spark, docs.limit(0), SF).collect() == []
    last = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in last(spark, docs, SF).collect()} == {1, 2, 3, 4, None}
    near = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in near) == ["1", "3", "4"]


def test_null_ids_of_one_class_leave_one_row(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "A B C D E F")], "doc_id long, text string")
    assert len(corpus_pipeline.near_dedup(spark, docs, SF).collect()) == 1
