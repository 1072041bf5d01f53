"""Scoring: fit, intent and engagement stage, the bucket and the one-line justification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions.build import built_once
from leadlane.functions.text import any_keyword, capitalize, strip
from leadlane.operators import notes as N
from leadlane.operators.clean import as_unit

VERDICT_COLUMNS = (
    "score", "raw_score", "recommendation", "hard_disqualify", "justification", "fit_score", "intent_score",
    "engagement_score", "engagement_stage", "title_tier", "is_agency_icp", "is_adjacent_icp", "notes_too_vague",
)

# What the verdict is derived from. Filters on these stop at the finished scores.
SCORE_COLUMNS = (
    "score", "raw_score", "hard_disqualify", "fit_score", "intent_score", "engagement_score", "engagement_stage",
    "title_tier", "is_agency_icp", "is_adjacent_icp", "notes_too_vague", "no_contact", "hard_notes",
)


def limit(value: Column, band: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(band), value))


def title_tier(title: Column) -> Column:
    lowered = strip(F.lower(title))
    tier = F.when(title.isNull() | (title == ""), "unknown")
    for name, _, keywords in rules.TITLE_TIERS:
        tier = tier.when(any_keyword(lowered, keywords), name)
    return tier.otherwise("other")


def title_points(tier: Column) -> Column:
    points = F.when(tier == "unknown", rules.TITLE_UNKNOWN_POINTS)
    for name, value, _ in rules.TITLE_TIERS:
        points = points.when(tier == name, value)
    return points.otherwise(rules.TITLE_OTHER_POINTS)


def score_title(title: Column) -> Column:
    """Struct of the points and the tier of a job title."""
    tier = title_tier(title)
    return F.struct(title_points(tier).alias("points"), tier.alias("tier"))


def score_employees(employees: Column) -> Column:
    return (
        F.when(employees.isNull(), rules.EMPLOYEES_UNKNOWN_POINTS)
        .when(employees >= rules.EMPLOYEES_FLOOR, rules.EMPLOYEES_FIT_POINTS)
        .otherwise(rules.EMPLOYEES_SMALL_POINTS)
    )


def score_stated_budget_intent(budget: Column) -> Column:
    points = F.when(budget.isNull(), rules.BUDGET_UNKNOWN_POINTS)
    for floor, value in rules.BUDGET_BANDS:
        points = points.when(budget >= floor, value)
    return points.otherwise(0.0)


def score_icp(is_agency_icp: Column, is_adjacent_icp: Column) -> Column:
    return F.when(is_agency_icp, rules.AGENCY_POINTS).when(is_adjacent_icp, rules.ADJACENT_POINTS).otherwise(0.0)


def recommend(
    score: Column, hard_disqualify: Column, contact_now: float | Column, nurture: float | Column
) -> Column:
    """Bucket of a score. Contact Now is tried first, whatever the order of the thresholds."""
    return (
        F.when(hard_disqualify, rules.DISQUALIFY)
        .when(score >= contact_now, rules.CONTACT_NOW)
        .when(score >= nurture, rules.NURTURE)
        .otherwise(rules.DISQUALIFY)
    )


@built_once
def _signals() -> dict[str, Column]:
    reachable = F.col("name").isNotNull() | F.col("email").isNotNull() | F.col("company").isNotNull()
    return {
        "no_contact": ~reachable,
        "hard_notes": N.is_hard(),
        "reason_text": F.concat_ws(
            "; ", *[F.when(N.hit(r), F.lit(label)) for r, _, label in rules.HARD_DISQUALIFIERS]
        ),
        "signal_text": F.array_join(
            F.slice(N.names_hit(N.TAGS, [label for *_, label in rules.INTENT_SIGNALS]), 1, 2), " and "
        ),
        "is_agency_icp": N.is_agency(),
        "is_adjacent_icp": N.is_adjacent(),
        "notes_too_vague": ~N.any_hit(N.TAGS),
        "weights": N.weight_sum(),
        "stage": N.stage_of_hits(),
    }


@built_once
def _raw_points() -> dict[str, Column]:
    """Points before the bands are applied."""
    stage_points = F.when(F.col("stage") == rules.SALES_READY, rules.STAGE_POINTS[rules.SALES_READY])
    stage_points = stage_points.when(F.col("stage") == rules.WARM, rules.STAGE_POINTS[rules.WARM])
    return {
        "hard_disqualify": F.col("no_contact") | F.col("hard_notes"),
        "fit_raw": title_points(F.col("title_tier"))
        + score_employees(F.col("employees"))
        + score_icp(F.col("is_agency_icp"), F.col("is_adjacent_icp")),
        "intent_raw": F.when(F.col("notes_too_vague"), rules.NO_SIGNAL_POINTS).otherwise(F.col("weights"))
        + score_stated_budget_intent(F.col("monthly_budget")),
        "stage_raw": stage_points.otherwise(rules.STAGE_POINTS[rules.COLD]),
    }


@built_once
def _components() -> dict[str, Column]:
    """The components within their bands; a hard disqualifier leaves nothing."""
    open_ = ~F.col("hard_disqualify")
    return {
        "fit_score": F.when(open_, limit(F.col("fit_raw"), rules.FIT_BAND)).otherwise(0.0),
        "intent_score": F.when(open_, limit(F.col("intent_raw"), rules.INTENT_BAND)).otherwise(0.0),
        "engagement_score": F.when(open_, F.col("stage_raw")).otherwise(0.0),
        "raw_score": F.when(open_, F.col("fit_raw") + F.col("intent_raw") + F.col("stage_raw")).otherwise(0.0),
        "stage": F.when(open_, F.col("stage")).otherwise(rules.COLD),
        "title_tier": F.when(open_, F.col("title_tier")).otherwise("unknown"),
        "is_agency_icp": open_ & F.col("is_agency_icp"),
        "is_adjacent_icp": open_ & F.col("is_adjacent_icp"),
        "notes_too_vague": open_ & F.col("notes_too_vague"),
    }


@built_once
def _totals() -> dict[str, Column]:
    labels = F.when(F.col("stage") == rules.SALES_READY, rules.STAGE_LABELS[rules.SALES_READY])
    labels = labels.when(F.col("stage") == rules.WARM, rules.STAGE_LABELS[rules.WARM])
    return {
        "score": F.col("fit_score") + F.col("intent_score") + F.col("engagement_score"),
        "engagement_stage": labels.otherwise(rules.STAGE_LABELS[rules.COLD]),
    }


def score_parts(df: DataFrame, notes_are_clean: bool = True) -> DataFrame:
    """Add everything the verdict needs that does not depend on the thresholds.

    Expects clean ``notes``, ``title``, ``employees``, ``monthly_budget``, ``name``, ``email`` and ``company``;
    notes that are not yet clean are cleaned if the flag says so.
    """
    text = N.clean_note_text(F.col("notes")) if notes_are_clean else N.note_text(F.col("notes"))
    texts = df.withColumns({"note_text": text, "title_tier": title_tier(F.col("title"))})
    signals = N.add_hits(texts).withColumns(_signals()).drop("note_text", *N.HIT_COLUMNS)
    components = signals.withColumns(_raw_points()).withColumns(_components())
    complete = components.withColumns(_totals()).drop("weights", "fit_raw", "intent_raw", "stage_raw")
    return as_unit(complete, SCORE_COLUMNS)


@built_once
def _justification() -> Column:
    """The sentence that explains a verdict. Only its last words depend on the thresholds."""
    fit = (
        F.when(F.col("is_agency_icp"), rules.AGENCY_LABEL)
        .when(F.col("is_adjacent_icp"), rules.ADJACENT_LABEL)
        .otherwise(rules.OFF_ICP_LABEL)
    )
    phrase = F.lit("")
    for tier, words in rules.TITLE_PHRASES.items():
        phrase = F.when(F.col("title_tier") == tier, f" with {words}").otherwise(phrase)
    signals = F.when(F.col("signal_text") == "", rules.NO_SIGNAL_CLAUSE).otherwise(F.col("signal_text"))
    opening = (
        F.when(F.col("no_contact"), rules.NO_CONTACT_LABEL)
        .when(F.col("hard_notes"), F.col("reason_text"))
        .when(F.col("notes_too_vague"), fit)
        .otherwise(F.concat(fit, phrase))
    )
    stage = F.lower("engagement_stage")
    middle = (
        F.when(F.col("hard_disqualify"), "")
        .when(F.col("notes_too_vague"), F.concat(F.lit(f"; {rules.VAGUE_CLAUSE}; "), stage))
        .otherwise(F.concat(F.lit("; "), signals, F.lit("; "), stage))
    )
    return F.concat(capitalize(opening), middle, F.lit(" -- "), F.col("recommendation"), F.lit("."))


def add_verdict(
    parts: DataFrame,
    contact_now: float = rules.CONTACT_NOW_THRESHOLD,
    nurture: float = rules.NURTURE_THRESHOLD,
) -> DataFrame:
    """Bucket and justification of scored rows for one pair of thresholds."""
    bucket = recommend(F.col("score"), F.col("hard_disqualify"), F.lit(float(contact_now)), F.lit(float(nurture)))
    return parts.withColumn("recommendation", bucket).withColumn("justification", _justification())


SCORING_HELPERS = ("no_contact", "hard_notes", "reason_text", "signal_text")


def qualify_leads(
    df: DataFrame,
    contact_now: float = rules.CONTACT_NOW_THRESHOLD,
    nurture: float = rules.NURTURE_THRESHOLD,
) -> DataFrame:
    """Whole verdict for a DataFrame of clean leads."""
    return add_verdict(score_parts(df, notes_are_clean=False), contact_now, nurture).drop(*SCORING_HELPERS)
