"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Best-fit decreasing then runs over the counts per length, at
most ``capacity`` numbers, and yields planned slots: "ranks a to b of this length go to sequences from s, at this
offset". Pieces are ranked within their length and take their slots by a join. The plan has the size of the length
grid, not of the corpus; no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlane.llm.common import give_back, slices
from leadlane.llm.segments import encoder
from leadlane.sources.staging import Workspace

WORD_TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1

#: Ranks that share a key in the join of pieces and slots.
_BLOCK = 64
#: Smallest group of equal lengths that is numbered by itself; larger lengths are dealt to several groups.
_GROUP = 256


def pieces(
    docs: DataFrame,
    tokenizer: str = WORD_TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers. Every document ends in ``end_id``, so null and empty texts
    give one piece of one token. Only documents of more than ``capacity`` tokens are cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder(tokenizer)
        give_back()  # what reading the tokenizer, and other work of this worker before, has left
        for part in slices(batches, "text"):
            n_tokens, ids = encoder(tokenizer).encode(part.column("text"))
            docs_at, numbers, starts, lengths, sums, binaries = [], [], [], [], [], []
            begin = 0
            for row, n in enumerate(n_tokens.tolist()):
                whole = np.append(ids[begin : begin + n], np.uint32(end_id)).astype("<u4", copy=False)
                begin += n
                for number, start in enumerate(range(0, n + 1, capacity)):
                    data = whole[start : start + capacity].tobytes()
                    docs_at.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(data) // 4)
                    sums.append(zlib.crc32(data))
                    if keep_ids:
                        binaries.append(data)
            columns = {
                "doc_id": part.column("doc_id").take(pa.array(docs_at, pa.int64())),
                "piece": pa.array(numbers, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(binaries, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return rows.mapInArrow(cut, schema)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset) for runs of ranks.

    Sequences that are filled alike are handled as one run, so the work follows the number of lengths and of runs,
    not the number of pieces. Every rank from 0 to the count of its length gets exactly one slot.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put_back(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
                taken = min(n, total - rank)
                slots.append((length, rank, taken, first, capacity - left))
                rank += taken
                put_back(left, first + taken, n - taken)
                put_back(left - length, first, taken)
                continue
            each = capacity // length
            full, rest = divmod(total - rank, each)
            for k in range(each if full else 0):
                slots.append((length, rank, full, opened, k * length))
                rank += full
            put_back(capacity - each * length, opened, full)
            opened += full
            for k in range(rest):
                slots.append((length, rank, 1, opened, k * length))
                rank += 1
            put_back(capacity - rest * length, opened, int(rest > 0))
            opened += rest > 0
    return slots


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: tuple[str, ...]) -> DataFrame:
    """Rows of whole numbers, given to Spark as Arrow columns: a list of rows would take Python workers of its own."""
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], list(names)))


def pack(cut: DataFrame, capacity: int = CAPACITY, workspace: Workspace | None = None) -> DataFrame:
    """Give every row of a table with a ``length`` column a ``sequence_id`` and an ``offset``.

    Lengths must be between 1 and ``capacity``; anything else is an error. Rows are taken as they are: equal rows,
    null ids and any other columns pass through, and an empty table stays empty. Columns that are called
    ``sequence_id`` or ``offset`` already are replaced.
    """
    spark = cut.sparkSession
    workspace = workspace or Workspace(spark)
    names = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    inner = [f"c{i}" for i in range(len(names))]
    staged = workspace.stage(
        cut.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], F.col("length").cast("long").alias("len"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    # One row per length, of which there are at most ``capacity``.
    found = staged.groupBy("len").count().limit(capacity + 1).collect()
    if any(r["len"] is None or not 1 <= r["len"] <= capacity for r in found):
        raise ValueError(f"Lengths must be between 1 and {capacity}")
    histogram = {r["len"]: r["count"] for r in found}

    groups = [(n, 1 + count // max(_GROUP, int(count**0.5))) for n, count in histogram.items()]
    dealt = staged.join(F.broadcast(_table(spark, groups, ("len", "groups"))), "len").withColumn(
        "grp", F.pmod(F.xxhash64("row"), F.col("groups"))
    )
    sizes = dealt.groupBy("len", "grp").agg(F.count("*").alias("n"))
    before = sizes.withColumn(
        "before",
        F.coalesce(F.sum("n").over(Window.partitionBy("len").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("n")
    within = F.row_number().over(Window.partitionBy("len", "grp").orderBy("row")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["len", "grp"]).withColumn("rank", F.col("before") + F.col("within"))

    plan = _table(spark, plan_slots(histogram, capacity), ("len", "first", "n", "seq", "offset"))
    slots = plan.select(
        "*", F.explode(F.expr(f"sequence(first div {_BLOCK}, (first + n - 1) div {_BLOCK})")).alias("block")
    )
    placed = ranked.withColumn("block", F.expr(f"rank div {_BLOCK}")).join(slots.hint("merge"), ["len", "block"])
    placed = placed.filter("rank >= first AND rank < first + n")
    return placed.select(
        *[F.col(i).alias(c) for c, i in zip(names, inner)],
        (F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"),
        F.col("offset"),
    )
