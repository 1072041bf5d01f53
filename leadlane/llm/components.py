"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.sources.staging import Workspace


def _smallest(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Smallest neighbour of every first node, staged so that the join with it can split large nodes."""
    return workspace.stage(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, root`` for every node of an edge table ``a, b`` of long numbers; the root is the smallest node.

    Each round links the larger neighbours of every node to its smallest one, then the smaller ones, which keeps the
    components and shortens the paths to stars in a logarithmic number of rounds. Tables are written between rounds.
    Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    edges = workspace.stage(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = workspace.stage(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
        least = _smallest(both, workspace, "large-star").select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = workspace.stage(large.distinct(), "after-large")
        least = _smallest(large, workspace, "small-star")
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = workspace.stage(least.select("u", F.col("m").alias("v")).unionAll(moved).distinct(), "after-small")
        # Stars: no node has two roots, and no root has one.
        if moved.isEmpty() and edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
