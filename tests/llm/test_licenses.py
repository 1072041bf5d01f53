from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlane.llm import licenses
from leadlane.llm.license_expression import evaluate, expression_tokens, postfix
from leadlane.llm.license_terms import BASE_PHRASES, BASE_WEIGHT, NOTICE_PHRASES, TAG_WEIGHT
from leadlane.llm.queries import op12_licenses

SF = "/root/testdata/sf0.001"
NOT_WORD = {chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    return "".join(" " if c in NOT_WORD else c for c in lower(text or "")).split(" ")


def plain(text):
    """Places by comparing every word with the start of every phrase; labels of the tags apart."""
    words = [w for w in split(text) if w]
    every = {p: (label, BASE_WEIGHT) for p, label in BASE_PHRASES.items()} | NOTICE_PHRASES
    places = [(i, p) for i in range(len(words)) for p in every if words[i : i + len(p.split())] == p.split()]
    base = [(i, p) for i, p in places if p in BASE_PHRASES]
    weights = {}
    for _, p in places:
        label, weight = every[p]
        weights[label] = max(weights.get(label, 0), weight)
    for line in re.findall(r"spdx-license-identifier:([^\n]*)", text or "", re.I | re.A):
        terms = evaluate(line.strip())
        for label in terms.labels if terms else ():
            weights[label] = TAG_WEIGHT
    left = 1.0
    for label in sorted(weights):
        left *= 1 - weights[label]
    at = [i for i, _ in base]
    return (
        len(words), len(base), min(at, default=None), max(at, default=None),
        ",".join(sorted({BASE_PHRASES[p] for _, p in base})), ",".join(sorted(weights)), round(1 - left, 9),
    )


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")


def digest(row):
    return (*(row[c] for c in COLUMNS), round(row["score"], 9))


@pytest.mark.parametrize(
    "text, labels, duty",
    [
        ("MIT", "mit", "permissive"),
        ("mit or GPL-2.0-only", "gpl,mit", "permissive"),
        ("MIT AND GPL-2.0-or-later", "gpl,mit", "strong"),
        ("MIT OR Apache-2.0 AND GPL-3.0+", "apache,gpl,mit", "permissive"),
        ("(MIT OR Apache-2.0) AND GPL-3.0+", "apache,gpl,mit", "strong"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl", "weak"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MPL-2.0", "gpl,mpl", "weak"),
        ("GPL-2.0-only WITH some-other-exception", "gpl", "strong"),
        ("((LGPL-2.1-only))", "lgpl", "weak"),
        ("CC-BY-NC-4.0", "cc-by-nc", "restricted"),
        ("CC-BY-NC-SA-4.0", "cc-by-nc-sa", "restricted"),
        ("CC-BY-SA-4.0 OR CC0-1.0", "cc-by-sa,cc0", "permissive"),
        ("My-Own-1.0", "my-own-1.0", "unknown"),
        ("MIT */", "mit", "permissive"),
        ("MIT -- more text", "mit", "permissive"),
        ("MIT and the rest is prose", "mit,the", "unknown"),
        ("MIT or", "mit", "permissive"),
        ("MIT) or so", "mit", "permissive"),
    ],
)
def test_expressions(text, labels, duty):
    terms = evaluate(text)
    assert (",".join(sorted(terms.labels)), terms.duty) == (labels, duty)


@pytest.mark.parametrize("text", ["", "(", ")", "AND MIT", "(MIT", "(MIT OR)", "NONE", "NOASSERTION", "(MIT OR Apache-2.0) WITH x", "é"])
def test_what_cannot_be_read(text):
    assert evaluate(text) is None


NAMES = ["MIT", "Apache-2.0", "GPL-2.0-only", "MPL-2.0", "CC-BY-NC-4.0"]
RANK = {"permissive": 0, "weak": 1, "strong": 2, "restricted": 3, "unknown": 4}
EXPRESSIONS = st.recursive(st.sampled_from(NAMES), lambda e: st.tuples(e, st.sampled_from(["AND", "OR"]), e), max_leaves=12)


def written(e, outer=0):
    """Text with no more brackets than needed on the left side, and the duty by the tree."""
    if isinstance(e, str):
        return e, RANK[evaluate(e).duty]
    (a, x), (b, y) = written(e[0], 1), written(e[2], 2)
    mine = f"({a} {e[1]} {b})" if outer else f"{a} {e[1]} {b}"
    return mine, max(x, y) if e[1] == "AND" else min(x, y)


@settings(max_examples=300, deadline=None)
@given(EXPRESSIONS)
def test_any_tree_is_evaluated_as_it_is_nested(e):
    text, rank = written(e)
    assert RANK[evaluate(text).duty] == rank
    assert len(postfix(expression_tokens(text))) == text.replace("(", " ").replace(")", " ").count(" ") - text.count("(") - text.count(")") + 1


def test_very_deep_expressions():
    assert evaluate("(" * 50_000 + "MIT" + ")" * 50_000).labels == {"mit"}
    assert evaluate(" AND ".join(["MIT"] * 50_000)).duty == "permissive"


def test_cases(spark):
    texts = [
        None, "", " ,.;\n", "MIT", "MIT License", "mit-license", "mit license", "MIT’ license", "submit license", "mit licenses",
        "Apache License MIT license apache license; GNU General Public License. ", "mit license mit license mit_license\x00mit\tLICENSE",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nx",
        "SPDX-License-Identifier: NOASSERTION", "spdx-license-identifier:", "İ SPDX-License-Identifier: ISCİ",
        "Licensed under CC BY-NC 4.0.", "Redistribution and use in source and binary forms, with or without", "GNU Lesser General Public License",
        "a " * 200_000 + "released under the MIT License\n" * 3,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "mit license")] * 2, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS n_words", "2 AS Hits", "3 AS `a.b`", "'x' AS labels")
    found = licenses.scan_licenses(docs)
    rows = licenses.judge(found).collect()
    assert {r["doc_id"]: digest(r) for r in rows if r["doc_id"] is not None} == {i: plain(t) for i, t in enumerate(texts)}
    assert [digest(r) for r in rows if r["doc_id"] is None] == [plain("mit license")] * 2
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[k]["duty"] for k in (12, 13, 14, 15, 16)] == ["weak", None, None, "permissive", None]
    assert by_id[12]["labels"] == "apache,gpl,mit" and by_id[15]["labels"] == "isc" and by_id[6]["labels"] == ""
    tag = found.filter("doc_id = 12").first()["tags"][0]
    assert (tag["start"], tag["expression"]) == (3, "MIT Apache-2.0 OR GPL-2.0-only Classpath-exception-2.0 WITH AND")
    assert licenses.judge(licenses.scan_licenses(docs.limit(0))).collect() == []
    assert licenses.scan_licenses(docs.selectExpr("text AS body", "text AS name"), "name", "body").count() == len(rows)


def test_query_agrees_with_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: digest(r) for r in op12_licenses(spark, SF).collect()}
    assert rows == {d: plain(t) for d, t in docs}
    assert {r[4] for r in rows.values()} >= {"", "mit"}
