from __future__ import annotations

import random

import pytest

from leadlane.llm import decontaminate as d

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        text[at : at + rng.choice((0, 1, 1))] = rng.choice(("", "x", "y"))
    return "".join(text)


def smallest_distance(pattern, text):
    above = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return min(above)


def test_agrees_with_aligning_everything(spark):
    rng = random.Random(11)
    items = [(i, words(rng, rng.randint(6, 40))) for i in range(6)] + [(6, "too short"), (7, None), (None, words(rng, 12))]
    docs = [(0, None), (1, ""), (2, words(rng, 3))]
    for i in range(3, 40):
        text = words(rng, rng.randint(0, 30))
        if i % 3:
            _, passage = items[rng.randrange(6)]
            text = f"{text}\n{edited(rng, passage, rng.randint(0, len(passage) // 8)).upper()}** {words(rng, rng.randint(0, 20))}"
        docs.append((i, text))
    docs += [docs[-1], (None, items[0][1])]
    expected = set()
    windows = d.Windows([(i, d.normalise(t)) for i, t in items])
    for doc, text in docs:
        for item, pattern, budget in zip(windows.item_of, windows.texts, windows.budgets):
            # Short items count as a whole between word boundaries, and a text's ends are such boundaries.
            whole = b" " + d.normalise(text) + b" " if pattern[:1] == b" " else d.normalise(text)
            if smallest_distance(pattern, whole) <= budget:
                expected.add((doc, item))
    table = spark.createDataFrame(docs, DOCS).selectExpr("*", "7 AS item_id", "1 AS edits")
    found = d.find_passages(table, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    assert len([r for r in found if r["doc_id"] == docs[-2][0]]) in (0, 2)
    assert len(expected) > 15


def test_blocks_of_the_benchmark_add_up(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, d.find_passages(docs, items).collect()))
    assert one == sorted(map(tuple, d.find_passages(docs, items, block_bytes=1000).collect()))
    assert one


def test_verbatim_items_are_all_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    from leadlane.llm.queries import op10_decontaminate

    found = {(r["doc_id"], r["item_id"]) for r in op10_decontaminate(spark, sf).collect()}
    whole = {(x["doc_id"], i["item_id"]) for x in docs for i in items if d.normalise(i["text"]) in d.normalise(x["text"])}
    assert whole and whole <= found and len(found) < 1.2 * len(whole) + 3


@pytest.mark.parametrize("docs, items", [([], [(1, "x" * 90)]), ([(1, "x" * 90)], []), ([], [])])
def test_empty_tables(spark, docs, items):
    out = d.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert out.collect() == [] and out.columns[:2] == ["doc_id", "item_id"]


def test_a_very_long_text(spark):
    rng = random.Random(2)
    item = words(rng, 25)
    text = words(rng, 150_000) + " " + item + " " + words(rng, 150_000)
    out = d.find_passages(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(5, item)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in out] == [(1, 5, 0)]
    assert d.normalise(text)[out[0]["start"] : out[0]["end"]] == d.normalise(item)


def test_short_items_and_short_excerpts(spark):
    rng = random.Random(4)
    long = words(rng, 200)
    items = [(0, "Which planet has rings, and which has no moon?"), (1, "a-b"), (2, long), (3, "***"), (4, "")]
    whole = d.normalise(items[0][1]).decode()
    docs = [(0, items[0][1]), (1, f"{words(rng, 9)} {whole.upper()}! {words(rng, 9)}"), (2, f"x{whole} y"), (3, whole.replace("rings", "ring"))]
    docs += [(4, "A b."), (5, "a b c"), (6, "..."), (7, "")]
    places = [rng.randrange(len(long) - 124) for _ in range(40)]
    docs += [(100 + n, f"{words(rng, 5)} #{long[at : at + 124]}# {words(rng, 5)}") for n, at in enumerate(places)]
    out = d.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out}
    assert found == {(0, 0), (1, 0), (4, 1)} | {(100 + n, 2) for n in range(40)}
    for r in out:
        if r["item_id"] == 0:
            assert d.normalise(docs[r["doc_id"]][1])[r["start"] : r["end"]].decode() == whole
    left = d.clean_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 3, 5, 6, 7]
