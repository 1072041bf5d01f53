"""Row numbers without sorting or gathering the rows.

Every row is staged with Spark's ``monotonically_increasing_id``, which counts up within a partition. The
number of rows in front of each partition (or file block) is a running sum over a table with one row per
partition, which is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlane.sources.staging import BROADCAST_ROWS, Workspace, workspace_of

# Low bits of monotonically_increasing_id: position within the partition. High bits: the partition.
_POSITION_BITS = 33


def partition_of(id_: Column) -> Column:
    return F.shiftright(id_, _POSITION_BITS)


def position_of(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def running_before(counts: DataFrame, amount: str, order_by: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rows_before``: the sum of ``amount`` over the rows in front."""
    window = Window.partitionBy(*within).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rows_before", F.coalesce(F.sum(amount).over(window), F.lit(0)))


def join_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join a staged table that has one row per task; broadcast it only if its counted size allows."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on)


def number_sorted(staged: DataFrame, id_: str, name: str, workspace: Workspace, start: int) -> DataFrame:
    """Replace the id column of a staged table by the row number, counted from ``start``."""
    rows = staged.withColumn("part", partition_of(F.col(id_)))
    counts = rows.groupBy("part").agg(F.count("*").alias("part_rows"))
    before = workspace.stage(running_before(counts, "part_rows", "part").drop("part_rows"), "offsets")
    numbered = join_small(rows, before, ["part"])
    return numbered.withColumn(name, F.col("rows_before") + position_of(F.col(id_)) + start).drop(
        "part", "rows_before", id_
    )


def number_rows(df: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Add ``source_row`` to a table that has none: its reading order, counted as lines below a header."""
    workspace = workspace_of(df, workspace)
    staged = workspace.stage(df.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    return number_sorted(staged, "row_id", "source_row", workspace, start=2)
