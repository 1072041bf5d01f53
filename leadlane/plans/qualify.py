"""The whole job as one DataFrame: a verdict for every input row, from which all tables derive."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.operators.clean import check_columns, clean_rows, origin_columns, row_keys
from leadlane.operators.dedup import dedupe
from leadlane.operators.explore import bucket_scores, count_each, filter_leads
from leadlane.operators.ranking import rank_leads, top_leads
from leadlane.operators.scoring import add_verdict, recommend, score_parts
from leadlane.plans.publish import publish, read_published
from leadlane.sources.lead_csv import read_leads_csv, write_csv
from leadlane.sources.ordinals import number_rows
from leadlane.sources.staging import Workspace, workspace_of

STAT_COLUMNS = ("total_rows_read", "junk_rows_dropped", "duplicate_rows_dropped", "qualified_rows")
SCORES = ("fit_score", "intent_score", "engagement_score", "score")


def _decide(raw: DataFrame, workspace: Workspace) -> tuple[DataFrame, int]:
    """The rows with their reasons, and how many were read."""
    cleaned, seen = workspace.stage_counted(clean_rows(raw).drop("created_raw"), "clean", rows=F.count(F.lit(1)))
    resolved = dedupe(cleaned, eligible=F.col("reason").isNull(), workspace=workspace)
    return resolved.withColumn("reason", F.coalesce("reason", F.when(~F.col("is_primary"), rules.DUPLICATE))), seen["rows"]


def dispositions(raw: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Clean fields of every input row with its ``reason`` for exclusion, null for the leads kept.

    Deduplication reads the cleaned rows twice, to find the winners and to look them up, so they are written
    once instead of being parsed twice.
    """
    return _decide(raw, workspace_of(raw, workspace))[0]


def lead_rows(decided: DataFrame) -> DataFrame:
    """Clean fields of the decided rows that go on to scoring."""
    return decided.filter("reason IS NULL").drop("reason", "is_primary", "duplicate_of", "raw_id", "raw_notes")


def kept_leads(raw: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Clean fields of the leads that go on to scoring."""
    return lead_rows(dispositions(raw, workspace))


def ranked_columns(verdicts: DataFrame) -> list:
    """The output columns: unknown texts empty, unknown numbers null, scores to one decimal."""
    texts = ("name", "email", "company", "website", "title", "source")
    shown = {c: F.coalesce(F.col(c), F.lit("")) for c in texts} | {c: F.bround(F.col(c), 1) for c in SCORES}
    return [shown.get(c, F.col(c)).alias(c) for c in rules.RANKED_COLUMNS]


@dataclass
class LeadRun:
    """Result of one run; every table is a lazy view.

    ``decided`` has the input rows with their ``reason`` for exclusion, null for leads, which a materialised run leaves
    out of it; ``parts`` has the leads with their scores. What concerns excluded rows is read from ``decided`` alone, so
    they are never scored. ``rows_read`` is the number of input rows, if it was counted, and ``counts`` what was observed
    when the run was materialised, for its thresholds.
    """

    decided: DataFrame
    parts: DataFrame
    contact_now: float = rules.CONTACT_NOW_THRESHOLD
    nurture: float = rules.NURTURE_THRESHOLD
    workspace: Workspace | None = None
    rows_read: int | None = None
    counts: dict[str, int] | None = None

    @property
    def leads(self) -> DataFrame:
        return add_verdict(self.parts, self.contact_now, self.nurture)

    def _worded(self, sorted_parts: DataFrame) -> DataFrame:
        """Output columns of sorted leads; the sentence is written after the sort."""
        worded = add_verdict(sorted_parts, self.contact_now, self.nurture)
        return worded.select(*ranked_columns(worded))

    def ranked(self) -> DataFrame:
        """The 19 output columns, best lead first. The sort samples its input, so scores are best materialised."""
        return self._worded(rank_leads(self.parts))

    def top(self, n: int) -> DataFrame:
        """The first n of the ranked table; only they get a sentence."""
        return self._worded(top_leads(self.parts, n))

    def filtered(self, **filters) -> DataFrame:
        """The ranked leads that pass the filters of ``explore.lead_filter``; only these are sorted.

        Buckets are also put as bounds of the score, which a materialised run is clustered by, so that the scan skips
        what holds other scores.
        """
        parts = self.parts
        if (buckets := filters.get("recommendations")) is not None:
            filters["recommendations"] = buckets = list(buckets)
            parts = parts.filter(bucket_scores(buckets, self.contact_now, self.nurture))
        passing = filter_leads(add_verdict(parts, self.contact_now, self.nurture), **filters)
        return rank_leads(passing).select(*ranked_columns(passing))

    def excluded(self) -> DataFrame:
        """Rows left out and why: junk rows as they came, then duplicates with their cleaned texts.

        With several input files, the file and the row's number in it come last.
        """
        out = self.decided.filter("reason IS NOT NULL")
        is_dup = F.col("reason") == rules.DUPLICATE
        detail = F.concat(F.lit("Duplicate of "), F.col("duplicate_of"))
        for code, text in rules.JUNK_DETAILS.items():
            detail = F.when(F.col("reason") == code, text).otherwise(detail)
        shown = {
            "lead_id": F.when(is_dup, F.col("lead_id")).otherwise(F.coalesce("raw_id", F.lit(""))),
            "notes": F.when(is_dup, F.col("notes")).otherwise(F.coalesce("raw_notes", F.lit(""))),
            "detail": detail,
        }
        ordered = out.orderBy(is_dup, *row_keys(out))
        columns = [*rules.EXCLUDED_COLUMNS, *origin_columns(out)]
        return ordered.select(*[shown.get(c, F.col(c)).alias(c) for c in columns])

    def stats(self) -> DataFrame:
        """One row: the four row counts and the number of leads per bucket; a materialised run has counted them."""
        if self.counts:
            totals = ", ".join(f"{self.counts[c]}L AS {c}" for c in STAT_COLUMNS)
            buckets = ", ".join(f"'{b}', {self.counts[b]}L" for b in rules.BUCKETS)
            return self.parts.sparkSession.sql(f"SELECT {totals}, map({buckets}) AS counts_by_recommendation")
        rows = self.decided.select("reason", F.lit(None).cast("string").alias("bucket")).filter("reason IS NOT NULL")
        leads = self.leads.select(F.lit("").alias("reason"), F.col("recommendation"))
        reason, bucket = F.col("reason"), F.col("bucket")
        counted = rows.unionAll(leads).agg(
            F.count("reason").alias("total_rows_read"),
            F.count_if(reason.isin(*rules.JUNK_DETAILS)).alias("junk_rows_dropped"),
            F.count_if(reason == rules.DUPLICATE).alias("duplicate_rows_dropped"),
            F.count_if(reason == "").alias("qualified_rows"),
            *[F.count_if(bucket == b).alias(b) for b in rules.BUCKETS],
        )
        buckets = F.create_map(*[part for b in rules.BUCKETS for part in (F.lit(b), F.col(b))])
        return counted.withColumn("counts_by_recommendation", buckets).drop(*rules.BUCKETS)

    def recommendation_counts(self) -> DataFrame:
        return count_each(self.leads, "recommendation", rules.BUCKETS, "leads")

    def excluded_counts(self) -> DataFrame:
        return count_each(self.decided, "reason", rules.REASONS, "excluded_rows")

    def with_thresholds(self, contact_now: float, nurture: float) -> LeadRun:
        """The same leads in other buckets; nothing but the bucket and the end of the sentence changes."""
        return replace(self, contact_now=contact_now, nurture=nurture, counts=None)

    def materialize(self, workspace: Workspace | None = None) -> LeadRun:
        """Write the excluded rows and the scored leads once; all tables then read what is written.

        Both writes count their rows on the way, so the summary needs no pass of its own. Rows that do not add up to
        those read are an error. Scores are written in order within each file.
        """
        workspace = workspace or self.workspace or Workspace(self.decided.sparkSession)
        reason = F.col("reason")
        excluded, left_out = workspace.stage_counted(
            self.decided.filter("reason IS NOT NULL"),
            "excluded",
            excluded=F.count(F.lit(1)),
            junk_rows_dropped=F.count_if(reason.isin(*rules.JUNK_DETAILS)),
            duplicate_rows_dropped=F.count_if(reason == rules.DUPLICATE),
        )
        bucket = recommend(F.col("score"), F.col("hard_disqualify"), F.lit(float(self.contact_now)), F.lit(float(self.nurture)))
        per_bucket = {b: F.count_if(bucket == b) for b in rules.BUCKETS}
        scored, leads = workspace.stage_counted(self.parts.sortWithinPartitions("score"), "scored", qualified_rows=F.count(F.lit(1)), **per_bucket)
        total = left_out["excluded"] + leads["qualified_rows"]
        check_total(self.rows_read, total)
        return replace(self, decided=excluded, parts=scored, rows_read=total, counts={"total_rows_read": total, **left_out, **leads})

    def close(self) -> None:
        """Delete the run's intermediate tables; its DataFrames can no longer be used."""
        if self.workspace:
            self.workspace.clear()

    def __enter__(self) -> LeadRun:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def check_total(rows_read: int | None, rows_written: int) -> None:
    """Every row read is a lead or an excluded row, once."""
    if rows_read is not None and rows_read != rows_written:
        raise RuntimeError(f"{rows_read:,} rows were read, but leads and excluded rows are {rows_written:,}")


def qualify(
    raw: DataFrame,
    contact_now: float = rules.CONTACT_NOW_THRESHOLD,
    nurture: float = rules.NURTURE_THRESHOLD,
    workspace: Workspace | None = None,
) -> LeadRun:
    """Run on a DataFrame of raw leads; rows without ``source_row`` are numbered in reading order.

    The cleaned rows are written at once, as deduplication reads them twice. ``close`` the run, or use it in a
    ``with`` statement, to delete them; what is left goes when the process ends.
    """
    check_columns(raw)
    workspace = workspace_of(raw, workspace)
    if "source_row" not in raw.columns:
        raw = number_rows(raw, workspace)
    decided, rows_read = _decide(raw, workspace)
    return LeadRun(decided, score_parts(lead_rows(decided)), contact_now, nurture, workspace, rows_read)


def run(
    spark: SparkSession,
    source: str | list[str] | DataFrame,
    contact_now: float = rules.CONTACT_NOW_THRESHOLD,
    nurture: float = rules.NURTURE_THRESHOLD,
    multiline: bool | None = None,
    encoding: str = "UTF-8",
    workspace: Workspace | None = None,
    origin: bool | None = None,
) -> LeadRun:
    """Run on CSV files or on a DataFrame.

    ``origin`` says whether the excluded table ends in the file and the row's number in it; by default it does if there
    is more than one input file.
    """
    workspace = workspace or Workspace(spark)
    raw = source
    if not isinstance(source, DataFrame):
        if origin is None:
            origin = len(spark.read.text(source).inputFiles()) > 1
        raw = read_leads_csv(spark, source, multiline, encoding, workspace)
        if not origin:
            raw = raw.drop("source_file", "file_row")
    return qualify(raw, contact_now, nurture, workspace)


def write_outputs(result: LeadRun, output_path: str, excluded_path: str | None = None, fmt: str = "csv") -> None:
    """Write the ranked and, if asked for, the excluded table, each as a folder of CSV or Parquet files.

    Both are published together, and only if their rows add up to those that were read.
    """
    written: dict[str, Observation] = {}

    def writer(name: str, df: DataFrame):
        written[name] = Observation()
        counted = df.observe(written[name], F.count(F.lit(1)).alias("rows"))

        def write(path: str) -> None:
            if fmt == "csv":
                write_csv(counted, path)
            else:
                counted.write.mode("overwrite").format(fmt).save(path)

        return write

    def check() -> None:
        if excluded_path:
            check_total(result.rows_read, sum(seen.get["rows"] for seen in written.values()))

    tables = [(output_path, writer("ranked", result.ranked()))]
    if excluded_path:
        tables.append((excluded_path, writer("excluded", result.excluded())))
    publish(result.parts.sparkSession, tables, check)


def read_outputs(spark: SparkSession, output_path: str, excluded_path: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """The ranked and the excluded table of one run, also if the job that wrote them died while publishing."""
    options = {"header": True, "escape": '"', "multiLine": True} if fmt == "csv" else {}
    ranked, excluded = read_published(spark, [output_path, excluded_path], lambda p: spark.read.options(**options).format(fmt).load(p))
    return ranked, excluded


def summary_lines(result: LeadRun) -> list[str]:
    """The counts of a run as lines of text: a label from the fixed values and a number each."""
    counts = result.counts
    if not counts:
        stats = result.stats().first()
        counts = {**stats.asDict(), **stats["counts_by_recommendation"]}
    totals = [(label, counts[name]) for name, label in rules.SUMMARY_LABELS.items()]
    buckets = [(f"  {b}", counts[b]) for b in rules.BUCKETS]
    width = max(len(label) for label, _ in totals + buckets) + 2
    return [f"{label:<{width}}{n:>12,}" for label, n in totals + buckets]
