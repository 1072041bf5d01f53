"""Cleaning projection: raw leads to typed records, one output row per input row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions import contact, dates, numbers
from leadlane.functions.build import built_once
from leadlane.functions.text import blank_to_null, squeeze, strip
from leadlane.operators.junk import junk_reason

CLEAN_COLUMNS = (
    "source_row", "lead_id_raw", "lead_id_canonical", "lead_id_is_explicit_dup", "lead_id",
    "created_raw", "created_date", "created", "name", "email", "email_valid", "company",
    "employees", "website", "title", "source", "monthly_budget", "notes",
)


def check_columns(df: DataFrame) -> None:
    absent = [c for c in rules.COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"No column {', '.join(absent)} among {df.columns}")


def row_keys(df: DataFrame) -> list[str]:
    """Columns that identify an input row, in reading order: its number, and its file where numbers start anew."""
    if "source_row" not in df.columns:
        raise ValueError("Input has no source_row column; number the rows first (sources.ordinals.number_rows)")
    return [c for c in ("source_row", "source_file") if c in df.columns]


def origin_columns(df: DataFrame) -> list[str]:
    """Columns that say where an input row came from, beside its number."""
    return [c for c in ("source_file", "file_row") if c in df.columns]


@built_once
def _stripped() -> list[Column]:
    raw = {c: F.col(c).cast("string") for c in rules.COLUMNS}
    kept = [raw["lead_id"].alias("raw_id"), raw["created"].alias("raw_created"), raw["notes"].alias("raw_notes")]
    return kept + [strip(raw[c]).alias(c) for c in rules.COLUMNS]


@built_once
def _cells() -> list[Column]:
    return [blank_to_null(F.col(c)).alias(c) for c in rules.COLUMNS]


def to_cells(df: DataFrame) -> DataFrame:
    """Turn the eleven raw columns into cells; the raw id, date and notes stay beside them."""
    check_columns(df)
    keys = list(dict.fromkeys([*origin_columns(df), *row_keys(df)]))
    return df.select(*keys, *_stripped()).select(*keys, "raw_id", "raw_created", "raw_notes", *_cells())


def as_unit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same rows, with some columns (or all) behind a generator that filters are not moved through.

    Without it, a filter on a derived column is rewritten in terms of the raw texts, and everything between
    the two is computed a second time, for the filter alone. Other columns can still be pruned and filtered.
    """
    unit = list(columns or df.columns)
    beside = [c for c in df.columns if c not in unit]
    return df.select(*beside, F.inline(F.array(F.struct(*unit)))).select(*df.columns)


def with_junk_reason(df: DataFrame) -> DataFrame:
    """Cells of every input row with the junk ``reason``, null for leads."""
    return to_cells(df).withColumn("reason", junk_reason())


@built_once
def _parsed() -> list[Column]:
    return [
        *[F.when(F.col("reason").isNotNull(), F.col(c)).alias(c) for c in ("raw_id", "raw_notes")],
        F.col("raw_created").alias("created_raw"),
        F.col("lead_id").alias("lead_id_raw"),
        contact.id_digits(F.col("lead_id")).alias("id_digits"),
        contact.is_explicit_dup(F.col("lead_id")).alias("lead_id_is_explicit_dup"),
        F.col("created").alias("created_cell"),
        squeeze(F.col("name")).alias("name"),
        contact.email_text(F.col("email")).alias("address"),
        squeeze(F.col("company")).alias("company"),
        numbers.employees(F.col("employees")).alias("employees"),
        contact.website_text(F.col("website")).alias("site"),
        squeeze(F.col("title")).alias("title"),
        F.lower(squeeze(F.col("source"))).alias("source"),
        numbers.budget_text(F.col("monthly_budget")).alias("budget_text"),
        F.coalesce(squeeze(F.col("notes")), F.lit("")).alias("notes"),
    ]


@built_once
def _typed() -> dict[str, Column]:
    return {
        "email": contact.email_or_null(F.col("address")),
        "email_valid": contact.email_is_valid(F.col("address")),
        "monthly_budget": numbers.budget(F.col("budget_text")),
        "website": contact.empty_to_null(F.col("site")),
        "lead_id_canonical": contact.empty_to_null(F.col("id_digits")),
        "lead_id": F.when(F.col("id_digits") != "", F.col("lead_id_raw")).otherwise(
            F.concat(F.lit("ROW-"), F.col("source_row"))
        ),
    }


@built_once
def _created() -> Column:
    """The date as shown: ISO, else the text as it came."""
    return F.coalesce(F.date_format("created_date", "yyyy-MM-dd"), squeeze(F.col("created_cell")), F.lit(""))


def clean_rows(df: DataFrame) -> DataFrame:
    """Every input row with its clean fields and its junk ``reason`` (null for leads).

    Junk rows keep their raw id and notes, which the audit shows. The steps are separate projections so that
    each parsed text is computed once.
    """
    keys = row_keys(df)
    extra = [c for c in dict.fromkeys([*keys, *origin_columns(df)]) if c not in CLEAN_COLUMNS]
    parsed = with_junk_reason(df).select(*extra, "source_row", "reason", *_parsed())
    typed = dates.add_date(parsed, "created_cell", "created_date").withColumns(_typed())
    return typed.withColumn("created", _created()).select(*extra, *CLEAN_COLUMNS, "reason", "raw_id", "raw_notes")


def clean_records(df: DataFrame) -> DataFrame:
    """Clean fields of the rows that are leads."""
    return as_unit(clean_rows(df), ["reason"]).filter("reason IS NULL").drop("reason", "raw_id", "raw_notes")
