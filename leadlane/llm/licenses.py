"""Licence notices and identifier tags of whole texts.

Texts become their lower-case words, set apart by single spaces, so that one Aho-Corasick automaton finds the phrases of
all notices in one pass, whatever stood between the words. Identifier tags are found by another one in the text itself,
as their expressions need its brackets; a shunting-yard parser reads those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import slices
from leadlane.llm.license_expression import evaluate
from leadlane.llm.license_terms import BASE_PHRASES, BASE_WEIGHT, DUTIES, NOTICE_PHRASES, TAG, TAG_WEIGHT

#: Everything in ASCII but digits and letters separates words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HITS = "array<struct<word:bigint,words:int,phrase:string,label:string,base:boolean,weight:double>>"
TAGS = "array<struct<start:bigint,expression:string,labels:array<string>,duty:string>>"
_HITS = pa.list_(
    pa.struct([("word", pa.int64()), ("words", pa.int32()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("weight", pa.float64())])
)
_TAGS = pa.list_(pa.struct([("start", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("duty", pa.string())]))


@lru_cache(maxsize=1)
def _automata():
    """The automaton of all phrases, with a space on either side, and that of the tag; one each per Python worker."""
    import ahocorasick

    phrases, tag = ahocorasick.Automaton(), ahocorasick.Automaton()
    every = {p: (label, True, BASE_WEIGHT) for p, label in BASE_PHRASES.items()}
    every |= {p: (label, False, weight) for p, (label, weight) in NOTICE_PHRASES.items()}
    for phrase, (label, base, weight) in every.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, phrase, label, base, weight))
    tag.add_word(TAG, len(TAG))
    phrases.make_automaton()
    tag.make_automaton()
    return phrases, tag


def _hits(words: str) -> list[dict]:
    """Phrases in a text of words with a space around each, by place, then phrase."""
    found, upto, spaces = [], 0, 0
    places = sorted((end - size + 1, phrase, label, base, weight) for end, (size, phrase, label, base, weight) in _automata()[0].iter(words))
    for at, phrase, label, base, weight in places:
        spaces += words.count(" ", upto, at)
        upto = at
        found.append({"word": spaces, "words": phrase.count(" ") + 1, "phrase": phrase, "label": label, "base": base, "weight": weight})
    return found


def _tags(text: str, lower: str) -> list[dict]:
    """Identifier tags with the rest of their line; labels and duty are null where it cannot be read."""
    found = []
    for last, _ in _automata()[1].iter(lower):
        stop = text.find("\n", last + 1)
        line = text[last + 1 : stop if stop >= 0 else len(text)].strip()
        terms = evaluate(line)
        expression = " ".join(terms.postfix) if terms else line
        found.append(
            {"start": last + 1 - len(TAG), "expression": expression, "labels": sorted(terms.labels) if terms else None, "duty": terms.duty if terms else None}
        )
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, hits, tags`` of every row of ``docs``, from its whole text.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. ``hits`` lists every place where a
    phrase of ``license_terms`` stands, by its first word (from 0) and then the phrase, with its label, whether it is one
    of the base phrases, and its weight. ``tags`` lists every SPDX identifier tag with its place (in characters), its
    expression in postfix form, the labels of all its licences and the duty of the choice that asks least; where the
    expression cannot be read, the rest of its line stands there and labels and duty are null.

    Null and empty texts have no words, hits or tags. Phrases may overlap, and a place counts once per phrase. Rows are
    judged one by one: repeated rows give equal rows, null ids stay null. Other columns are not read, an empty table
    gives an empty result, and nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = pc.fill_null(part.column("text"), "")
            lower = pc.ascii_lower(texts)
            spaced = pc.replace_substring_regex(pc.binary_join_element_wise(" ", lower, " ", ""), _BETWEEN, " ")
            # One space before every word and one at the end; a text without words is a single one.
            n_words = pc.subtract(pc.count_substring(spaced, " "), 1).cast(pa.int64())
            hits = [_hits(t) for t in spaced.to_pylist()]
            tagged = np.flatnonzero(pc.match_substring(lower, TAG).to_numpy(zero_copy_only=False))
            tags: list[list[dict]] = [[] for _ in hits]
            for i in tagged.tolist():
                tags[i] = _tags(texts[i].as_py(), lower[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), n_words, pa.array(hits, _HITS), pa.array(tags, _TAGS)], ["doc_id", "n_words", "hits", "tags"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, hits {HITS}, tags {TAGS}")


def judge(found: DataFrame) -> DataFrame:
    """Per document the base places, the labels found and how sure they are.

    ``n_base``, ``first_word`` and ``last_word`` speak of base phrases only; the words are null if there are none. Labels
    are distinct, sorted and joined by commas, an empty text if there are none. A phrase that lies within a longer one
    of another licence family, such as "general public license" within "lesser general public license", keeps its label
    if it is a base phrase. ``score`` is the chance that any evidence is right: 1 minus the product, over labels and tags,
    of what the strongest sign of each leaves open; 0 without any. ``duty`` is the heaviest of the tags' duties.
    """
    base = F.expr("filter(hits, h -> h.base)")
    known = F.expr("filter(tags, t -> t.labels IS NOT NULL)")
    out = found.withColumn("base", base).withColumn("known", known)
    out = out.withColumn("base_found", F.expr("array_sort(array_distinct(base.label))"))
    out = out.withColumn("found", F.expr("array_sort(array_distinct(concat(hits.label, flatten(known.labels))))"))
    duties = f"array({', '.join(map(repr, DUTIES))})"
    strongest = f"""transform(found, l -> greatest(
        coalesce(array_max(transform(filter(hits, h -> h.label = l), h -> h.weight)), 0D),
        if(array_contains(flatten(known.labels), l), {TAG_WEIGHT}D, 0D)))"""
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(base.word)").alias("first_word"),
        F.expr("array_max(base.word)").alias("last_word"),
        F.array_join("base_found", ",").alias("base_labels"),
        F.array_join("found", ",").alias("labels"),
        F.expr(f"1D - aggregate({strongest}, 1D, (left, w) -> left * (1D - w))").alias("score"),
        F.when(F.size("known") > 0, F.expr(f"{duties}[cast(array_max(transform(known.duty, d -> array_position({duties}, d))) - 1 AS int)]")).alias("duty"),
    )
