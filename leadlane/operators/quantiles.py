"""Exact quantiles of several columns, computed from their distributed histogram."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlane.sources.ordinals import join_small, partition_of, running_before
from leadlane.sources.staging import Workspace, workspace_of


def profile(
    df: DataFrame,
    metrics: tuple[str, ...],
    quantiles: dict[str, float],
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per metric: ``n``, ``min``, ``max`` and the interpolated quantiles of its non-null values.

    Equal values are counted first, so no value is too frequent for one task; the distinct values are sorted
    by range, and each range is accumulated on its own on top of the rows in front of it.
    """
    workspace = workspace_of(df, workspace)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    values = df.select(pairs.alias("pair")).select("pair.*").filter("value IS NOT NULL")
    histogram = values.groupBy("metric", "value").agg(F.count("*").alias("rows"))
    ranges = histogram.repartitionByRange("metric", "value")
    staged = workspace.stage(ranges.withColumn("range_id", F.monotonically_increasing_id()), "histogram")
    staged = staged.withColumn("part", partition_of(F.col("range_id")))

    parts = staged.groupBy("metric", "part").agg(F.sum("rows").alias("part_rows"))
    parts = running_before(parts, "part_rows", "part", ("metric",))
    totals = F.sum("part_rows").over(Window.partitionBy("metric"))
    parts = workspace.stage(parts.withColumn("n", totals).drop("part_rows"), "histogram-offsets")

    inside = Window.partitionBy("metric", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_small(staged, parts, ["metric", "part"]).withColumn(
        "before", F.col("rows_before") + F.coalesce(F.sum("rows").over(inside), F.lit(0))
    )

    def value_at(ordinal):
        holds = (F.col("before") <= ordinal) & (ordinal < F.col("before") + F.col("rows"))
        return F.max(F.when(holds, F.col("value")))

    at = {name: (F.col("n") - 1) * q for name, q in quantiles.items()}
    ends = reduce(
        list.__add__,
        [
            [value_at(F.floor(p)).alias(f"{name}_low"), value_at(F.ceil(p)).alias(f"{name}_high")]
            for name, p in at.items()
        ],
        [],
    )
    found = placed.groupBy("metric", "n").agg(F.min("value").alias("min"), F.max("value").alias("max"), *ends)
    between = [
        (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (p - F.floor(p))).alias(name)
        for name, p in at.items()
    ]
    return found.select("metric", "n", "min", *between, "max")
