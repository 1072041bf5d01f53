"""Order of the ranked table, rank numbers and top n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane.operators.clean import row_keys
from leadlane.sources.ordinals import number_sorted
from leadlane.sources.staging import Workspace, workspace_of


def rank_order(df: DataFrame) -> list[Column]:
    """Score, then the score before limiting, then id; the input row makes the order total.

    As no two rows are equal in it, a range sort can cut anywhere, also inside a score that many leads share.
    """
    return [F.desc("score"), F.desc("raw_score"), F.asc("lead_id"), *[F.asc(c) for c in row_keys(df)]]


def rank_leads(df: DataFrame) -> DataFrame:
    return df.orderBy(*rank_order(df))


def top_leads(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; every task keeps only n."""
    return rank_leads(df).limit(n)


def with_rank(df: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Add ``rank`` (1 is the best lead): range sort, staged, then offsets of the sorted partitions."""
    workspace = workspace_of(df, workspace)
    order = rank_order(df)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = workspace.stage(parts.withColumn("rank_id", F.monotonically_increasing_id()), "ranked")
    return number_sorted(staged, "rank_id", "rank", workspace, start=1)
