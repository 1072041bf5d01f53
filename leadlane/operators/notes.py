"""Notes classification: hard disqualifiers, intent tags, engagement stage and customer profile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions.build import built_once
from leadlane.functions.text import clean_text, fold_case, matches

HARD = [reason for reason, _, _ in rules.HARD_DISQUALIFIERS]
TAGS = [tag for tag, *_ in rules.INTENT_SIGNALS]
HIT_COLUMNS = [f"hit_{name}" for name in (*HARD, *TAGS, "not_agency", "agency", "adjacent")]


def hit(name: str) -> Column:
    return F.col(f"hit_{name}")


def clean_note_text(notes: Column) -> Column:
    """Text the patterns are matched against, from notes that are clean; empty when there are none."""
    return F.coalesce(fold_case(notes), F.lit(""))


def note_text(notes: Column) -> Column:
    """The same from notes as they come."""
    return clean_note_text(clean_text(notes))


@built_once
def _hit_columns(text: str) -> list[Column]:
    patterns = {reason: pattern for reason, pattern, _ in rules.HARD_DISQUALIFIERS}
    patterns |= {tag: pattern for tag, _, _, pattern, _ in rules.INTENT_SIGNALS}
    patterns |= {
        "not_agency": rules.NOT_AGENCY_PATTERN,
        "agency": rules.AGENCY_PATTERN,
        "adjacent": rules.ADJACENT_PATTERN,
    }
    return [matches(F.col(text), p).alias(f"hit_{n}") for n, p in patterns.items()]


def add_hits(df: DataFrame, text: str = "note_text") -> DataFrame:
    """One boolean column per pattern. Later steps only combine these, so every pattern runs once per row."""
    return df.select("*", *_hit_columns(text))


def any_hit(names: Sequence[str]) -> Column:
    return reduce(or_, [hit(n) for n in names])


def is_hard() -> Column:
    return any_hit(HARD)


def names_hit(names: Sequence[str], values: Sequence[str]) -> Column:
    """Values whose pattern matched, in the order of the table."""
    return F.array_compact(F.array(*[F.when(hit(n), F.lit(v)) for n, v in zip(names, values)]))


def weight_sum() -> Column:
    """Sum of the matched weights, not limited to a band."""
    return reduce(add, [F.when(hit(t), weight).otherwise(0.0) for t, weight, *_ in rules.INTENT_SIGNALS])


def stage_of_hits() -> Column:
    """The highest stage any matched tag reaches."""
    by_stage = {
        s: [t for t, _, stage, *_ in rules.INTENT_SIGNALS if stage == s] for s in (rules.SALES_READY, rules.WARM)
    }
    return (
        F.when(any_hit(by_stage[rules.SALES_READY]), rules.SALES_READY)
        .when(any_hit(by_stage[rules.WARM]), rules.WARM)
        .otherwise(rules.COLD)
    )


def is_agency() -> Column:
    return ~hit("not_agency") & hit("agency")


def is_adjacent() -> Column:
    return hit("not_agency") | (~hit("agency") & hit("adjacent"))


def classify_notes(df: DataFrame, notes: str = "notes", notes_are_clean: bool = False) -> DataFrame:
    """Add the note signals of every row; a hard disqualifier leaves the others empty."""
    text = clean_note_text(F.col(notes)) if notes_are_clean else note_text(F.col(notes))
    hits = add_hits(df.withColumn("note_text", text)).withColumn("hard_disqualify", is_hard())
    return hits.withColumns(_signal_columns()).drop(*HIT_COLUMNS)


@built_once
def _signal_columns() -> dict[str, Column]:
    open_ = ~F.col("hard_disqualify")
    none = F.array().cast("array<string>")
    return {
        "disqualify_reasons": names_hit(HARD, HARD),
        "tags": F.when(open_, names_hit(TAGS, TAGS)).otherwise(none),
        "stage": F.when(open_, stage_of_hits()).otherwise(rules.COLD),
        "is_agency_icp": open_ & is_agency(),
        "is_adjacent_icp": open_ & is_adjacent(),
        "notes_too_vague": open_ & ~any_hit(TAGS),
    }


def classify_engagement_stage(tags: Column) -> Column:
    """Engagement stage of an array of tags."""

    def has(stage: str) -> Column:
        of_stage = [t for t, _, s, *_ in rules.INTENT_SIGNALS if s == stage]
        return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in of_stage]))

    return (
        F.when(has(rules.SALES_READY), rules.SALES_READY).when(has(rules.WARM), rules.WARM).otherwise(rules.COLD)
    )


def raw_intent_sum(tags: Column) -> Column:
    """Unlimited weight sum of an array of tags."""
    return reduce(
        add,
        [F.when(F.array_contains(tags, tag), weight).otherwise(0.0) for tag, weight, *_ in rules.INTENT_SIGNALS],
    )


def score_notes_intent(tags: Column) -> Column:
    """Weight sum of an array of tags limited to its band; no tags at all score a small fixed amount."""
    limited = F.greatest(F.lit(0.0), F.least(F.lit(rules.NOTES_BAND), raw_intent_sum(tags)))
    return F.when(F.size(tags) == 0, rules.NO_SIGNAL_POINTS).otherwise(limited)
