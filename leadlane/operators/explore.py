"""Views on the ranked and excluded tables: filters, counts and threshold sweeps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions.contact import email_domain
from leadlane.operators.scoring import recommend

SEARCH_COLUMNS = ("name", "company", "email", "title")


def lead_filter(
    recommendations: Iterable[str] | None = None,
    score_range: tuple[float, float] | None = None,
    search: str = "",
    regex: bool = False,
) -> Column:
    """Condition on ranked leads: bucket, score range (both ends included) and search text, all of them.

    The search looks for the text in any of the name, company, e-mail and title, ignoring case. It is taken
    literally unless ``regex`` is set.
    """
    condition = F.lit(True)
    if recommendations is not None:
        condition &= F.col("recommendation").isin(*recommendations)
    if score_range is not None:
        condition &= F.col("score").between(*score_range)
    needle = search.strip().lower()
    if needle:
        texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in SEARCH_COLUMNS]
        condition &= reduce(or_, [t.rlike("(?U)" + needle) if regex else t.contains(needle) for t in texts])
    return condition


def bucket_scores(recommendations: Iterable[str], contact_now: float, nurture: float) -> Column:
    """Whether a score can belong to a lead in one of the buckets; Parquet statistics can decide it for whole pages.

    It follows from the bucket and never replaces that filter: hard disqualifiers, whose score is zero, share their
    score with other leads. Unknown buckets have no scores.
    """
    score = F.col("score")
    scores = {
        rules.CONTACT_NOW: score >= float(contact_now),
        rules.NURTURE: (score >= float(nurture)) & (score < float(contact_now)),
        rules.DISQUALIFY: (score < float(min(contact_now, nurture))) | (score <= 0.0),
    }
    return reduce(or_, [scores[b] for b in recommendations if b in scores], F.lit(False))


def filter_leads(ranked: DataFrame, **filters) -> DataFrame:
    return ranked.filter(lead_filter(**filters))


def filtered_counts(ranked: DataFrame, **filters) -> DataFrame:
    """One row: leads that pass the filters beside all leads."""
    return ranked.agg(F.count_if(lead_filter(**filters)).alias("shown"), F.count("*").alias("total"))


def with_icon(ranked: DataFrame) -> DataFrame:
    """Bucket prefixed by its icon, for display only."""
    icon = F.lit("")
    for bucket, sign in rules.BUCKET_ICONS.items():
        icon = F.when(F.col("recommendation") == bucket, sign).otherwise(icon)
    return ranked.withColumn("recommendation", F.concat_ws(" ", icon, "recommendation"))


def count_each(df: DataFrame, column: str, values: Sequence[str], name: str) -> DataFrame:
    """Count of each listed value in the listed order, zero where there is none.

    One aggregate with a counter per value: every task sends a single row.
    """
    counters = [F.count_if(F.col(column) == value).alias(f"n{i}") for i, value in enumerate(values)]
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(value).alias(column), F.col(f"n{i}").alias(name))
        for i, value in enumerate(values)
    ]
    return df.agg(*counters).select(F.inline(F.array(*rows)))


def threshold_sweep(parts: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Leads per bucket for every (contact now, nurture) pair.

    Only the bucket depends on the thresholds, so leads are first counted per score and the grid is applied
    to these few rows.
    """
    pairs = [F.struct(F.lit(float(c)).alias("contact_now"), F.lit(float(n)).alias("nurture")) for c, n in grid]
    scores = parts.groupBy("score", "hard_disqualify").agg(F.count("*").alias("leads"))
    cells = scores.withColumn("pair", F.explode(F.array(*pairs))).select("score", "hard_disqualify", "leads", "pair.*")
    bucket = recommend(F.col("score"), F.col("hard_disqualify"), F.col("contact_now"), F.col("nurture"))
    counted = cells.withColumn("bucket", bucket).groupBy("contact_now", "nurture")
    return counted.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("leads"))), F.lit(0)).alias(
                b.lower().replace(" ", "_") + "_leads"
            )
            for b in rules.BUCKETS
        ]
    )


def email_matches_website(email: Column, website: Column) -> Column:
    """Whether the domain of a cleaned address is the cleaned website; null if either is unknown."""
    return email_domain(email) == website
