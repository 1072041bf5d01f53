"""Customer-profile analyses of the leads with the strongest signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions.contact import website_tld
from leadlane.functions.text import matches
from leadlane.operators import notes as N
from leadlane.operators.quantiles import profile
from leadlane.sources.staging import Workspace

# Up to two words in front of "agency".
VERTICAL_PATTERN = r"(?U)(\w+(?: \w+)?) agency"
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def strongest_cohort(leads: DataFrame) -> DataFrame:
    """Leads whose notes hold both a budget commitment and an urgency phrase."""
    hits = N.add_hits(leads.withColumn("note_text", N.clean_note_text(F.col("notes"))))
    strong = ~N.is_hard() & N.any_hit(rules.COHORT_COMMITMENT_TAGS) & N.hit(rules.COHORT_URGENCY_TAG)
    return hits.filter(strong).drop(*N.HIT_COLUMNS)


def size_and_budget(cohort: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    return profile(cohort, ("employees", "monthly_budget"), QUARTILES, workspace)


def title_counts(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("title").agg(F.count("*").alias("leads"))


def vertical_counts(cohort: DataFrame) -> DataFrame:
    vertical = F.nullif(F.regexp_extract("note_text", VERTICAL_PATTERN, 1), F.lit(""))
    return cohort.select(vertical.alias("vertical")).groupBy("vertical").agg(F.count("*").alias("leads"))


def tld_counts(cohort: DataFrame) -> DataFrame:
    return cohort.select(website_tld(F.col("website")).alias("tld")).groupBy("tld").agg(F.count("*").alias("leads"))


def pain_point_counts(cohort: DataFrame) -> DataFrame:
    """Leads that mention each pain point, zero where none does."""
    found = [F.count_if(matches(F.col("note_text"), p)).alias(f"n{i}") for i, (_, p) in enumerate(rules.PAIN_POINTS)]
    rows = [
        F.struct(F.lit(label).alias("pain_point"), F.col(f"n{i}").alias("leads"))
        for i, (label, _) in enumerate(rules.PAIN_POINTS)
    ]
    return cohort.agg(*found).select(F.inline(F.array(*rows)))
