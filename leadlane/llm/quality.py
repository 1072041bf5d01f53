"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted, one from trusted
documents and one from all documents; a document's score is the mean log ratio of its n-grams. Every trusted document
counts. Everything is a DataFrame expression: arrays within a row, one explode with counting on the map side, and a
weight table that has the size of the bucket grid. Trusted documents are told by a join, which a Bloom filter of their
ids, of bounded size, keeps most others out of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import SPACES, words_of
from leadlane.operators.key_filter import blocks_for, key_filter, with_may_hold
from leadlane.operators.quantiles import profile
from leadlane.sources.staging import Workspace, workspace_of

BUCKETS = 1 << 14
#: The threshold lies this many times the distance from median to 5th percentile below the trusted median.
SPREADS = 3.0
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _sum(values: Column, zero: str) -> Column:
    return F.aggregate(values, F.expr(zero), lambda total, x: total + x)


def _bucket(value: Column) -> Column:
    return value.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))


def with_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and ``h``, the 64-bit hashes of its words in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    return _hashed(rows)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic, each once."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def with_trust(docs: DataFrame, trusted: DataFrame, workspace: Workspace) -> DataFrame:
    """``docs`` with ``is_trusted``, 1 or null. Both are read twice, so they should be cheap to read.

    Rows that the filter of the trusted ids lets through are shuffled, all others, also those without an id, stay where
    they are.
    """
    blocks = blocks_for(trusted.count())
    # As text, ids hash alike whatever integer type each table holds them in.
    key = F.col("doc_id").cast("string")
    held = workspace.stage(key_filter(trusted.select(key.alias("id")), "id", blocks), "trusted-filter")
    rows = with_may_hold(docs, held, key, blocks, "may_be_trusted")
    flags = trusted.withColumn("is_trusted", F.lit(1))
    met = rows.filter("may_be_trusted").join(flags, "doc_id", "left")
    others = rows.filter("NOT may_be_trusted").withColumn("is_trusted", F.lit(None).cast("int"))
    return met.select(*docs.columns, "is_trusted").unionAll(others.select(*docs.columns, "is_trusted"))


def fit_weights(docs: DataFrame, trusted: DataFrame, workspace: Workspace | None = None) -> list[float]:
    """Log ratio per bucket of the trusted to the whole corpus, both counts smoothed by one.

    All rows of ``docs`` (``doc_id``, ``text``) and all of ``trusted`` are counted; the result has ``BUCKETS`` numbers.
    Without trusted documents all weights are 0.
    """
    marked = _hashed(with_trust(docs.select("doc_id", "text"), trusted, workspace_of(docs, workspace)))
    pairs = F.transform(F.col("h"), lambda x, i: _bucket(F.xxhash64(x, F.get("h", i + 1))))
    grams = F.concat(F.transform("h", _bucket), F.slice(pairs, 1, F.greatest(F.size("h") - 1, F.lit(0))))
    counted = (
        marked.select(F.explode(grams).alias("bucket"), "is_trusted")
        .groupBy("bucket")
        .agg(F.count("*").alias("n_all"), F.count("is_trusted").alias("n_trusted"))
    )
    totals = {r["bucket"]: (r["n_all"], r["n_trusted"]) for r in counted.collect()}
    every, chosen = (sum(t[k] for t in totals.values()) + BUCKETS for k in (0, 1))
    if chosen == BUCKETS:
        return [0.0] * BUCKETS
    from math import log

    pairs_of = (totals.get(b, (0, 0)) for b in range(BUCKETS))
    return [log((t + 1) / chosen) - log((a + 1) / every) for a, t in pairs_of]


def with_score(hashed: DataFrame, weights: list[float]) -> DataFrame:
    """Add ``score``: the mean weight of the document's words and word pairs; null without words."""
    # One constant text that Catalyst folds into one array literal.
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    of_pair = lambda x, i: F.coalesce(F.get(table, _bucket(F.xxhash64(x, F.get("h", i + 1)))), F.lit(0.0))
    each = F.transform(
        F.col("h"),
        lambda x, i: F.get(table, _bucket(x)) + F.when(i + 1 < F.size("h"), of_pair(x, i)).otherwise(0.0),
    )
    n = F.size("h")
    return hashed.withColumn("score", F.when(n > 0, _sum(each, "0D") / (2 * n - 1)))


def fit_threshold(scored: DataFrame, trusted: DataFrame, workspace: Workspace | None = None) -> float | None:
    """From the exact median and 5th percentile of the trusted documents' scores; None without any.

    ``scored`` needs ``doc_id`` and ``score`` and is best a staged table. The scores are counted and sorted by range.
    """
    of_trusted = scored.select("doc_id", "score").join(trusted, "doc_id", "left_semi")
    row = profile(of_trusted, ("score",), {"mid": 0.5, "low": 0.05}, workspace).first()
    return None if row is None else row["mid"] - SPREADS * (row["mid"] - row["low"])


def with_measures(hashed: DataFrame) -> DataFrame:
    """Add the counts of the rules: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(SPACES.replace("[", "[^").rstrip("+"))))
    rows = hashed.withColumns(
        {
            "n_words": F.size("h").cast("long"),
            "word_chars": _without(text, SEPARATORS).cast("long"),
            "n_symbols": (F.char_length(text) - _without(text, SYMBOLS)).cast("long"),
            "lines": lines,
            "windows": F.transform(
                F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)),
            ),
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Positions are sorted by window only where some window comes twice.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    by_window = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("by_window", F.when(repeats, by_window))
    found = F.transform(
        F.col("by_window"),
        lambda x, i: F.when(
            F.coalesce(F.get("by_window", i - 1)["w"] == x["w"], F.lit(False))
            | F.coalesce(F.get("by_window", i + 1)["w"] == x["w"], F.lit(False)),
            x["i"],
        ),
    )
    rows = rows.withColumn("starts", F.sort_array(F.filter(found, lambda p: p.isNotNull())))
    covered = F.transform(F.col("starts"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1), p + 3) - p))
    rows = rows.withColumn("n_repeat_words", F.coalesce(_sum(covered, "0"), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("lines", "windows", "by_window", "starts")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``score``, ``base_failed`` and ``kept`` of every row of ``docs``.

    A document is kept if it passes the rules on counts and its score reaches the threshold. Null and empty texts
    have no words and fail; null ids are never trusted; equal rows get equal verdicts; other columns are not read.
    Without labels there is no threshold and the counts decide alone. An empty table gives an empty result.
    """
    return _judged(with_hashes(docs, id_col, text_col), labels)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns as they are."""
    rows = with_hashes(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    kept = _judged(rows, labels).filter("kept")
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def _judged(hashed: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, scores and verdicts, and ``whole``, if there is one, of what the counts let pass.

    They are written before the threshold is known, so that texts are scored once; the threshold is fitted on what is
    written.
    """
    workspace = Workspace(hashed.sparkSession)
    trusted = workspace.stage(trusted_ids(labels), "trusted")
    weights = fit_weights(hashed, trusted, workspace)
    measured = with_measures(with_score(hashed, weights)).drop("text", "h")
    if "whole" in measured.columns:
        measured = measured.withColumn("whole", F.when(~F.col("base_failed"), F.col("whole")))
    staged = workspace.stage(measured, "scored")
    threshold = fit_threshold(staged, trusted, workspace)
    verdict = ~F.col("base_failed")
    if threshold is not None:
        verdict = verdict & (F.col("score") >= F.lit(threshold))
    return staged.withColumn("kept", verdict)
