"""Duplicate resolution: one primary record per key.

The winner of a group is the minimum of an ordered struct, so it is found by an aggregate that reduces on
the map side and never gathers a group in one task. Rows then look their winner up:

* all through a broadcast, where the table of winners is small;
* else keys of very large groups through a broadcast of at most ``HOT_GROUPS`` rows. With the largest groups out
  of the way, every other key holds fewer than one row in ``HOT_GROUPS``, whatever the data;
* of the others, rows that a Bloom filter of the winners' keys lets pass through a join. All rows whose key stands
  alone, or that have none, stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.operators.clean import row_keys
from leadlane.operators.key_filter import blocks_for, key_filter, with_may_hold
from leadlane.sources.staging import Workspace, workspace_of

# Groups of at least this many rows are looked up by broadcast, largest first, up to the bound below.
HOT_GROUP_ROWS = 100_000
HOT_GROUPS = 10_000
# Winners that take at most this much room as a Parquet file are broadcast.
BROADCAST_BYTES = 8 << 20


def completeness(fields: Sequence[str], df: DataFrame) -> Column:
    """Number of filled fields: not null and, for texts, not empty. Zero counts as filled."""
    types = dict(df.dtypes)
    filled = [
        F.col(f).isNotNull() & (F.col(f) != "") if types[f] == "string" else F.col(f).isNotNull() for f in fields
    ]
    return reduce(add, [F.when(c, 1).otherwise(0) for c in filled], F.lit(0))


def has_dup_marker(notes: Column) -> Column:
    return F.coalesce(F.lower(notes).contains(rules.DUPLICATE_MARKER), F.lit(False))


def _preference(df: DataFrame, key: str, fields: Sequence[str]) -> Column:
    """Smaller is better: unmarked, more complete, more recent (undated last), earlier row."""
    return F.struct(
        has_dup_marker(F.col("notes")).alias("marked"),
        (-completeness(fields, df)).alias("missing"),
        F.coalesce(-F.unix_date("created_date"), F.lit(2**31 - 1)).alias("age"),
        *[F.col(c) for c in row_keys(df)],
        F.coalesce(F.nullif(F.col("lead_id_raw"), F.lit("")), F.col(key)).alias("label"),
    )


def best_per_key(df: DataFrame, key: str, completeness_fields: Sequence[str]) -> DataFrame:
    """The winning struct and the number of rows of every key."""
    keyed = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    best = keyed.select(F.col(key).alias("win_key"), _preference(df, key, completeness_fields).alias("pref"))
    return best.groupBy("win_key").agg(F.min("pref").alias("winner"), F.count("*").alias("group_rows"))


def look_up_winners(df: DataFrame, won: DataFrame, usable_key: Column, workspace: Workspace | None = None) -> DataFrame:
    """Add ``is_primary`` and ``duplicate_of`` from the winners of the groups with more than one row.

    Winners are staged. If they are few they are broadcast. If not, a filter of their keys, of bounded size, tells which
    rows may belong to them; only those are shuffled. ``df`` is read once for these and once for the others, so it should
    be a staged table.
    """
    workspace = workspace_of(df, workspace)
    keys = row_keys(df)
    won = workspace.stage(won, "winners")
    rows = df.withColumn("look_up", F.nullif(usable_key, F.lit("")))
    if workspace.bytes_of(won) <= BROADCAST_BYTES:
        found = rows.join(F.broadcast(won.select("win_key", F.col("winner").alias("won_by"))), F.col("look_up") == F.col("win_key"), "left")
        return _decided(found, keys).drop("look_up", "win_key")
    hot = (
        won.filter(F.col("group_rows") >= HOT_GROUP_ROWS)
        .orderBy(F.desc("group_rows"), "win_key")
        .limit(HOT_GROUPS)
        .select(F.col("win_key").alias("hot_key"), F.col("winner").alias("hot_winner"))
    )
    blocks = blocks_for(won.count())
    held = workspace.stage(key_filter(won, "win_key", blocks), "key-filter")
    rows = rows.join(F.broadcast(hot), F.col("look_up") == F.col("hot_key"), "left")
    rows = with_may_hold(rows, held, F.col("look_up"), blocks, "may_be_one")
    shuffled = F.col("may_be_one") & F.col("hot_key").isNull()
    candidates = rows.filter(shuffled).join(won.select("win_key", "winner").hint("merge"), F.col("look_up") == F.col("win_key"), "left")
    others = rows.filter(~shuffled)
    found = candidates.withColumn("won_by", F.col("winner")).select(*df.columns, "won_by").unionAll(
        others.withColumn("won_by", F.col("hot_winner")).select(*df.columns, "won_by")
    )
    return _decided(found, keys)


def _decided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the winner of each row by ``is_primary`` and ``duplicate_of``."""
    own = reduce(and_, [F.col(c) == F.col("won_by")[c] for c in keys])
    rows = rows.withColumn("is_primary", F.col("won_by").isNull() | own)
    return rows.withColumn("duplicate_of", F.when(~F.col("is_primary"), F.col("won_by")["label"])).drop("won_by")


def dedupe(
    df: DataFrame,
    key: str = "lead_id_canonical",
    completeness_fields: Sequence[str] = rules.COMPLETENESS_FIELDS,
    eligible: Column | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Add ``is_primary`` and ``duplicate_of`` (label of the kept record, null for kept rows).

    Rows outside ``eligible`` and rows without a key are primaries of their own.
    """
    grouped = df if eligible is None else df.filter(eligible)
    won = best_per_key(grouped, key, completeness_fields).filter("group_rows > 1")
    return look_up_winners(df, won, F.col(key) if eligible is None else F.when(eligible, F.col(key)), workspace)


def dedupe_by_window(
    df: DataFrame,
    key: str = "lead_id_canonical",
    completeness_fields: Sequence[str] = rules.COMPLETENESS_FIELDS,
) -> DataFrame:
    """The same result in its shortest form. It sorts every group in one task: for small data and for tests."""
    usable = F.nullif(F.col(key), F.lit(""))
    group = F.coalesce(usable, F.concat_ws(" ", F.lit("row"), *row_keys(df)))
    window = Window.partitionBy(group).orderBy("pref").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    ranked = df.withColumn("pref", _preference(df, key, completeness_fields))
    ranked = ranked.withColumn("best", F.first("pref").over(window))
    return (
        ranked.withColumn("is_primary", F.col("best") == F.col("pref"))
        .withColumn("duplicate_of", F.when(~F.col("is_primary"), F.col("best")["label"]))
        .drop("pref", "best")
    )
