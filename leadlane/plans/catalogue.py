"""Every query of the engine on the leads derived from the orders table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions import contact, dates, numbers
from leadlane.functions.text import squeeze
from leadlane.operators import clean, dedup, explore, icp, notes, ranking, scoring
from leadlane.plans.job import compile_methods
from leadlane.plans.qualify import LeadRun, dispositions, kept_leads, qualify, ranked_columns, run
from leadlane.sources.lead_csv import write_csv
from leadlane.sources.order_leads import order_leads
from leadlane.sources.staging import Workspace
from leadlane.streaming.incremental import LeadStream

Query = Callable[[SparkSession, str], DataFrame]

# Settings of the queries below; the check SQL uses the same.
TOP_N = 100
SEARCH = "firm"
SCORE_RANGE = (20.0, 90.0)
FILTER_BUCKETS = (rules.CONTACT_NOW, rules.NURTURE)
SWEEP = tuple((c, n) for c in (55.0, 65.0, 75.0) for n in (30.0, 40.0, 50.0))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    compile_methods(spark)
    return order_leads(spark, sf_dir)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_cells(_raw(spark, sf_dir))


def _run(spark: SparkSession, sf_dir: str) -> LeadRun:
    return qualify(_raw(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_leads(_raw(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).leads


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.classify_notes(clean.clean_records(_raw(spark, sf_dir)), notes_are_clean=True)


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icp.strongest_cohort(_kept(spark, sf_dir))


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# --- fields ---------------------------------------------------------------------------------------------


def clean_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [squeeze(F.col(c)).alias(c) for c in ("name", "company", "title", "notes")]
    return _cells(spark, sf_dir).select("source_row", *texts, F.lower(squeeze(F.col("source"))).alias("source"))


def clean_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = _cells(spark, sf_dir).select("source_row", contact.email_text(F.col("email")).alias("address"))
    return address.select(
        "source_row",
        contact.email_or_null(F.col("address")).alias("email"),
        contact.email_is_valid(F.col("address")).alias("email_valid"),
    )


def email_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_email(spark, sf_dir).select("source_row", contact.email_domain(F.col("email")).alias("domain"))


def clean_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _cells(spark, sf_dir).select("source_row", contact.website_text(F.col("website")).alias("site"))
    return site.select("source_row", contact.empty_to_null(F.col("site")).alias("website"))


def website_tld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icp.tld_counts(_kept(spark, sf_dir))


def parse_lead_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("lead_id")
    parsed = _cells(spark, sf_dir).select(
        "source_row",
        cell.alias("raw"),
        contact.id_digits(cell).alias("digits"),
        contact.is_explicit_dup(cell).alias("is_explicit_dup"),
    )
    canonical = contact.empty_to_null(F.col("digits"))
    return parsed.select("source_row", "raw", canonical.alias("canonical"), "is_explicit_dup").withColumn(
        "looks_valid", F.col("canonical").isNotNull()
    )


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = dates.add_date(_cells(spark, sf_dir).select("source_row", "created"), "created", "created_date")
    return dated.select("source_row", _iso("created_date"))


def parse_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("source_row", numbers.employees(F.col("employees")).alias("employees"))


def parse_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _cells(spark, sf_dir).select("source_row", numbers.budget_text(F.col("monthly_budget")).alias("text"))
    return text.select("source_row", numbers.budget(F.col("text")).alias("monthly_budget"))


# --- junk, records, duplicates --------------------------------------------------------------------------


def junk_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_junk_reason(_raw(spark, sf_dir)).select("source_row", "reason")


def junk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junk_reason(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("rows"))


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = clean.clean_records(_raw(spark, sf_dir))
    return records.withColumn("created_date", _iso("created_date"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = clean.clean_records(_raw(spark, sf_dir))
    return records.select("source_row", dedup.completeness(rules.COMPLETENESS_FIELDS, records).alias("filled"))


def dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("source_row", "lead_id", "lead_id_canonical")


def dedup_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispositions(_raw(spark, sf_dir)).filter(~F.col("is_primary"))
    return rows.select("source_row", "lead_id", "duplicate_of")


# --- notes and scores -----------------------------------------------------------------------------------


def note_disqualify_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_join("disqualify_reasons", ",").alias("reasons")
    return _notes(spark, sf_dir).select("source_row", "hard_disqualify", reasons)


def note_intent_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("source_row", F.array_join("tags", ",").alias("tags"), "notes_too_vague")


def engagement_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _notes(spark, sf_dir)
    return signals.select("source_row", "stage", notes.classify_engagement_stage(F.col("tags")).alias("stage_of_tags"))


def icp_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("source_row", "is_agency_icp", "is_adjacent_icp")


def notes_intent_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _notes(spark, sf_dir).select("source_row", "tags")
    return tagged.select(
        "source_row",
        notes.score_notes_intent(F.col("tags")).alias("points"),
        notes.raw_intent_sum(F.col("tags")).alias("raw_points"),
    )


def title_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _cells(spark, sf_dir).select("source_row", squeeze(F.col("title")).alias("title"))
    return titles.select("source_row", scoring.score_title(F.col("title")).alias("s")).select("source_row", "s.*")


def employee_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_employees(spark, sf_dir)
    return parsed.select("source_row", scoring.score_employees(F.col("employees")).alias("points"))


def budget_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_budget(spark, sf_dir)
    return parsed.select("source_row", scoring.score_stated_budget_intent(F.col("monthly_budget")).alias("points"))


def fit_intent_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "source_row", "fit_score", "intent_score", "engagement_score", "score", "raw_score", "title_tier"
    )


def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("source_row", "hard_disqualify", "recommendation", "engagement_stage")


def justification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("source_row", "justification")


# --- outputs --------------------------------------------------------------------------------------------


def ranked_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Scores are written before the range sort samples them; the sentence is written after it.
    workspace = Workspace(spark)
    parts = workspace.stage(_run(spark, sf_dir).parts, "scored")
    leads = scoring.add_verdict(ranking.with_rank(parts, workspace))
    return leads.select("rank", *ranked_columns(leads))


def excluded_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).excluded()


def top_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).top(TOP_N)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _run(spark, sf_dir).stats()
    buckets = [
        F.col("counts_by_recommendation")[b].alias(b.lower().replace(" ", "_")) for b in rules.BUCKETS
    ]
    return stats.select("*", *buckets).drop("counts_by_recommendation")


def recommendation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).recommendation_counts()


def excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).excluded_counts()


def filtered_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _run(spark, sf_dir).filtered(recommendations=FILTER_BUCKETS, score_range=SCORE_RANGE, search=SEARCH)
    return explore.with_icon(shown)


def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = _scored(spark, sf_dir)
    return explore.filtered_counts(leads, recommendations=FILTER_BUCKETS, score_range=SCORE_RANGE, search=SEARCH)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.threshold_sweep(_scored(spark, sf_dir), SWEEP)


# --- customer profile -----------------------------------------------------------------------------------


def icp_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir).select("source_row", "lead_id", "title", "employees", "monthly_budget", "website")


def icp_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icp.size_and_budget(_cohort(spark, sf_dir))


def icp_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icp.title_counts(_cohort(spark, sf_dir))


def icp_verticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icp.vertical_counts(_cohort(spark, sf_dir))


def pain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icp.pain_point_counts(_cohort(spark, sf_dir))


def email_matches_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = clean.clean_records(_raw(spark, sf_dir))
    matched = explore.email_matches_website(F.col("email"), F.col("website"))
    return records.select("source_row", matched.alias("same_domain"))


# --- files and streams ----------------------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the raw leads in row order as CSV, read them back with row numbers of their own, and run."""
    workspace = Workspace(spark)
    path = f"{workspace.root}/leads.csv"
    raw = _raw(spark, sf_dir)
    write_csv(raw.orderBy("source_row").select(*rules.COLUMNS), path)
    return run(spark, path, workspace=workspace).materialize().ranked()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliver the raw leads to a file stream in several files, then read the primaries off the stream's tables."""
    workspace = Workspace(spark)
    inbox = f"{workspace.root}/inbox"
    _raw(spark, sf_dir).write.parquet(inbox)
    stream = LeadStream(spark, f"{workspace.root}/stream")
    stream.drain(inbox)
    return stream.current().leads.select("source_row", "lead_id", "score", "recommendation")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        clean_text_fields, clean_email, email_domain, clean_website, website_tld, parse_lead_id, parse_date,
        parse_employees, parse_budget, junk_reason, junk_counts, clean_records, completeness, dedup_kept,
        dedup_dropped, note_disqualify_reasons, note_intent_tags, engagement_stage, icp_class,
        notes_intent_clamped, title_tier, employee_points, budget_points, fit_intent_stage, recommendation,
        justification, ranked_leads, excluded_leads, top_leads, run_stats, recommendation_counts,
        excluded_counts, filtered_leads, filtered_counts, threshold_sweep, icp_cohort, icp_profile, icp_titles,
        icp_verticals, pain_points, email_matches_website, csv_round_trip, stream_ingest,
    )
}
