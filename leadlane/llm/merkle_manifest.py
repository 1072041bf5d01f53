"""Merkle manifest of a data set: a root over the leaves of all rows, and a proof for every row.

Leaves stand in the order of their ids within a group of rows, such as a source. Their places are found without sorting
rows: every group has a bitmap of its ids, built as 64-bit words by a bit-or that is reduced on the map side, so only
words that hold an id exist. A directory of running popcounts, in steps of 1,024 words, says how many ids stand in
front of each word, and a rank query adds the bits below an id's own. Places then are keys: a block of consecutive places
is an array of slots, which reduces several levels of its group's tree at once to one digest, the slot of a block above.
The roots of the groups, ordered by name, are reduced in the same way. Proofs go back down from block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlane.sources.ordinals import join_small, number_sorted
from leadlane.sources.staging import Workspace

#: Nodes that are hashed together, and levels that a block reduces at once.
FAN_OUT = 3
BLOCK_LEVELS = 5
#: Binary digits by which a step of the directory narrows ids, above the 6 of a word.
_STEP = 10

_PATH = "array<struct<left:string,right:string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(column: Column) -> Column:
    """A value for hashing: ``-`` for null, else its number of UTF-8 bytes, a colon and itself as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The hash of a row's values, in lower-case hex."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings on a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _join(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(nodes: list[str], in_group: int, fan_out: int, most: int) -> list[list[str]]:
    """A block's digests level by level: as many levels as a block has, or fewer where the whole group ends before."""
    out = [nodes]
    while len(out) <= most and in_group > 1:
        below = out[-1]
        out.append([_join(below[i : i + fan_out]) for i in range(0, len(below), fan_out)])
        in_group = -(-in_group // fan_out)
    return out


def _slots(block: pa.Scalar) -> list[dict]:
    return sorted(block.as_py(), key=lambda s: s["pos"])


def _reduce(fan_out: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, left = [], []
            for n, block in zip(batch.column("n").to_pylist(), batch.column("slots")):
                nodes = [s["digest"].hex() for s in _slots(block)]
                roots.append(bytes.fromhex(_levels(nodes, n, fan_out, BLOCK_LEVELS)[-1][0]))
                left.append(-(-n // fan_out**BLOCK_LEVELS))
            columns = [batch.column("gid"), pa.array(left, pa.int64()), batch.column("block"), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["gid", "n", "pos", "digest"])

    return reduce


def _paths(fan_out: int, leaves: bool):
    """Arrow function over blocks and the path from there to the root: a row per slot with its whole path."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = batch.column("path").to_pylist()
            for row, block in enumerate(batch.column("slots")):
                slots = _slots(block)
                levels = _levels([s["digest"].hex() for s in slots], batch.column("n")[row].as_py(), fan_out, BLOCK_LEVELS)[:-1]
                beside = []
                for nodes in levels:
                    runs = [(i, i - i % fan_out) for i in range(len(nodes))]
                    beside.append([("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan_out])) for i, a in runs])
                upper = [(s["left"], s["right"]) for s in above[row]]
                lefts, rights = [], []
                for i in range(len(slots)):
                    for pairs in beside:
                        lefts.append(pairs[i][0])
                        rights.append(pairs[i][1])
                        i //= fan_out
                    lefts.extend(s[0] for s in upper)
                    rights.extend(s[1] for s in upper)
                depth, n = len(beside) + len(upper), len(slots)
                steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(_PATH_ARROW.value_type))
                path = pa.ListArray.from_arrays(pa.array(range(0, depth * n + 1, depth) if depth else [0] * (n + 1), pa.int32()), steps)
                here = pa.array([row] * n, pa.int64())
                columns = {"gid": batch.column("gid").take(here), "pos": pa.array([s["pos"] for s in slots], pa.int64()), "path": path}
                if leaves:
                    columns["id"] = pa.array([s["id"] for s in slots], pa.int64())
                    columns["leaf"] = pa.array([s["digest"].hex() for s in slots])
                    columns["claim"] = pa.array([s["claim"].hex() for s in slots])
                for name in ("subroot", "name"):
                    columns[name] = batch.column(name).take(here)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return spread


class Manifest:
    """``root`` of all rows, ``groups`` with their roots, and ``proofs()`` of the rows.

    ``fields`` are the columns that a leaf is the hash of, in order. ``claim`` is a column with another leaf per row, such
    as one of the row as it was received, which goes to the proofs; without it the claim is the leaf itself.

    Ids are whole numbers; others are refused. Rows with a null id stand before all others of their group, and rows that
    share an id (or have none) are ordered by their leaves, so equal rows may change places, which no digest shows. Groups
    are ordered by the bytes of their names, the group of null first. Null fields and empty texts hash differently. One
    group or one id may hold any share of the rows. An empty table has no root (None) and no proofs. Further columns of
    any name are not read.
    """

    def __init__(
        self,
        docs: DataFrame,
        fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
        id_col: str = "doc_id",
        group_col: str = "source",
        claim: Column | None = None,
        fan_out: int = FAN_OUT,
        workspace: Workspace | None = None,
    ):
        self.workspace = workspace or Workspace(docs.sparkSession)
        self.fan_out = fan_out
        if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{id_col} must be a whole number")
        own = leaf(*[F.col(f"`{c}`") for c in fields])
        rows = docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("name"),
            F.unhex(own).alias("digest"),
            F.unhex(F.coalesce(claim, own) if claim is not None else own).alias("claim"),
        )
        stage = self.workspace.stage
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
        found = rows.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("no_id"))
        found = found.repartitionByRange("name").sortWithinPartitions("name").withColumn("row_id", F.monotonically_increasing_id())
        self.groups = stage(number_sorted(stage(found, "names"), "row_id", "gid", self.workspace, start=0), "groups")
        n_groups = self.groups.count()
        self.root: str | None = None
        self._paths_down: DataFrame | None = None
        if not n_groups:
            return
        placed = self._placed(join_small(rows, self.groups, ["name"]))
        blocks, tops = self._rounds(placed, ["pos", "id", "digest", "claim"])
        subroots = stage(tops.select("gid", "digest"), "subroots")
        nodes = subroots.select(F.lit(0).cast("long").alias("gid"), F.lit(n_groups).cast("long").alias("n"), F.col("gid").alias("pos"), "digest")
        upper, top = self._rounds(nodes, ["pos", "digest"])
        self.root = top.first()["digest"].hex()
        none = F.lit(None).cast("string")
        above = top.select("gid", "pos", F.expr(f"cast(array() AS {_PATH})").alias("path"), none.alias("subroot"), none.alias("name"))
        for level in reversed(upper):
            above = self._down(level, above)
        self.groups = stage(self.groups.join(subroots, "gid").select("gid", "name", "n", F.lower(F.hex("digest")).alias("subroot")), "group-roots")
        above = above.select(F.col("pos").alias("gid"), "path").join(self.groups.drop("n"), "gid").withColumn("pos", F.lit(0).cast("long"))
        for level in reversed(blocks[1:]):
            above = self._down(level, above)
        self._paths_down = self._down(blocks[0], above, leaves=True)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``pos``, their place in the group."""
        stage = self.workspace.stage
        word, bit = F.shiftright("id", 6).alias("word"), F.col("id").bitwiseAND(63).cast("int")
        words = rows.filter("id IS NOT NULL").groupBy("gid", word).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(id & 63 AS int))")).alias("bits"), F.count("*").alias("rows")
        )
        words = stage(words, "bitmaps")
        ends = words.agg(F.min("word").alias("low"), F.max("word").alias("high")).first()
        directory = self._running(words.select("gid", "word", "rows"), ends["low"] or 0, ends["high"] or 0)
        words = words.join(directory, ["gid", "word"])
        below = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(id & 63 AS int))"))
        repeated = not words.filter("rows > bit_count(bits)").isEmpty() or not self.groups.filter("no_id > 0").isEmpty()
        if repeated:
            rows, words = self._ties(rows, words, bit)
            more = F.expr("aggregate(more, 0L, (n, m) -> n + if(m.bit < (id & 63), m.rows, 0L))")
            below = below + F.coalesce(more, F.lit(0)) + F.coalesce("tie", F.lit(0))
        known = rows.filter("id IS NOT NULL").withColumn("word", F.shiftright("id", 6)).join(words, ["gid", "word"])
        columns = ["gid", "n", "id", "digest", "claim"]
        placed = known.select(*columns, (F.col("no_id") + F.col("before") + below).cast("long").alias("pos"))
        if repeated:
            placed = placed.unionByName(rows.filter("id IS NULL").select(*columns, F.col("tie").cast("long").alias("pos")))
        return placed

    def _running(self, counts: DataFrame, low: int, high: int) -> DataFrame:
        """``gid, word, before``: rows of the group's words in front, by running sums over steps of words."""
        rows_before = lambda w: F.coalesce(F.sum("rows").over(w.orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if high - low < 1 << _STEP:
            return counts.select("gid", "word", rows_before(Window.partitionBy("gid")).alias("before"))
        wide = F.shiftright("word", _STEP)
        upper = self.workspace.stage(counts.groupBy("gid", wide.alias("word")).agg(F.sum("rows").alias("rows")), "directory")
        upper = self._running(upper, low >> _STEP, high >> _STEP).select("gid", F.col("word").alias("step"), F.col("before").alias("step_before"))
        within = counts.withColumn("step", wide).withColumn("within", rows_before(Window.partitionBy("gid", "step")))
        return within.join(upper, ["gid", "step"]).select("gid", "word", (F.col("step_before") + F.col("within")).alias("before"))

    def _ties(self, rows: DataFrame, words: DataFrame, bit: Column) -> tuple[DataFrame, DataFrame]:
        """Rows with ``tie``, their place among rows of the same id, and words with ``more``, how many rows an id has too many."""
        stage = self.workspace.stage
        same = rows.groupBy("gid", "id").agg(F.count("*").alias("rows")).filter("rows > 1 OR id IS NULL")
        same = stage(same, "repeated-ids")
        more = same.filter("id IS NOT NULL").groupBy("gid", F.shiftright("id", 6).alias("word")).agg(
            F.collect_list(F.struct(bit.alias("bit"), (F.col("rows") - 1).alias("rows"))).alias("more")  # at most 64
        )
        tied = rows.alias("r").join(same.alias("s"), F.expr("r.gid = s.gid AND r.id <=> s.id"), "left_semi").select("gid", "id", "digest", "row")
        order = ["gid", "id", "digest", "row"]
        tied = tied.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_id", F.monotonically_increasing_id())
        tied = stage(number_sorted(stage(tied, "tied-rows"), "row_id", "at", self.workspace, start=0), "numbered-ties")
        first = tied.groupBy("gid", "id").agg(F.min("at").alias("first"))
        ties = tied.alias("t").join(first.alias("f"), F.expr("t.gid = f.gid AND t.id <=> f.id")).select("row", F.expr("at - first").alias("tie"))
        return rows.join(ties, "row", "left"), words.join(more, ["gid", "word"], "left")

    def _rounds(self, nodes: DataFrame, slot: list[str]) -> tuple[list[DataFrame], DataFrame]:
        """The blocks of every round up to one node per group, and those nodes."""
        rounds = []
        size = self.fan_out**BLOCK_LEVELS
        while True:
            blocks = nodes.groupBy("gid", "n", F.expr(f"pos div {size}").alias("block")).agg(F.collect_list(F.struct(*slot)).alias("slots"))
            blocks = self.workspace.stage(blocks, f"blocks-{len(rounds)}")
            rounds.append(blocks)
            nodes = blocks.mapInArrow(_reduce(self.fan_out), "gid long, n long, pos long, digest binary")
            nodes, slot = self.workspace.stage(nodes, "nodes"), ["pos", "digest"]
            if nodes.filter("n > 1").isEmpty():
                return rounds, nodes

    def _down(self, blocks: DataFrame, above: DataFrame, leaves: bool = False) -> DataFrame:
        """Paths of the slots of blocks from the paths of the blocks."""
        joined = blocks.join(above.withColumnRenamed("pos", "block"), ["gid", "block"])
        schema = f"gid long, pos long, path {_PATH}" + ", id long, leaf string, claim string" * leaves + ", subroot string, name string"
        out = joined.mapInArrow(_paths(self.fan_out, leaves), schema)
        return out if leaves else self.workspace.stage(out, "paths")

    def proofs(self) -> DataFrame:
        """``id, group, pos, leaf, claim, path, subroot, root`` of every row.

        ``path`` lists the siblings from the leaf to the root, those on the left and on the right of each level joined;
        ``fold(leaf, path)`` is the root again.
        """
        group = F.when(F.col("name") != "", F.substring("name", 2, 1 << 30)).alias("group")
        if self._paths_down is None:
            return self.workspace.spark.createDataFrame(
                [], f"id long, group string, pos long, leaf string, claim string, path {_PATH}, subroot string, root string"
            )
        return self._paths_down.select("id", group, "pos", "leaf", "claim", "path", "subroot", F.lit(self.root).alias("root"))
