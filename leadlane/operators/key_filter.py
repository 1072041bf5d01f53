"""A blocked Bloom filter of keys as a small Spark table.

A key sets a few bits in one block of 64 words, chosen by its hash. Blocks are built by a bit-or that is reduced on the
map side, and rows meet their block in a broadcast join, so rows whose key is surely not among the keys can be told
apart where they are. The number of blocks is bounded, and with it the size of the broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key while there is room, and bits that every key sets: about one other key in 300 passes by mistake.
BITS_PER_KEY = 12
BITS_SET = 4
#: Blocks of 512 bytes: 64 MB. Beyond some 45 million keys more others pass, and nothing else changes.
MOST_BLOCKS = 1 << 17

_BLOCK_BITS = 4096


def blocks_for(n_keys: int) -> int:
    return min(MOST_BLOCKS, n_keys * BITS_PER_KEY // _BLOCK_BITS + 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long")).cast("int")


def _bits(key: Column) -> list[Column]:
    """The places within the block that a key sets."""
    other = F.xxhash64(F.lit(1), key)
    return [F.shiftright(other, 12 * i).bitwiseAND(F.lit(_BLOCK_BITS - 1)).cast("int") for i in range(BITS_SET)]


def key_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block, words`` of a filter that holds the keys of a column."""
    key = F.col(column)
    places = keys.select(_block(key, blocks).alias("block"), F.explode(F.array(*_bits(key))).alias("place"))
    words = places.groupBy("block", F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")
    )
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most 64
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("by_word", w), F.lit(0).cast("long")))
    return words.groupBy("block").agg(by_word.alias("by_word")).select("block", every.alias("words"))


def with_may_hold(df: DataFrame, held: DataFrame, key: Column, blocks: int, name: str) -> DataFrame:
    """Add a column that is false only for rows whose key is null or not among the keys of the filter."""
    rows = df.withColumn("filter_block", _block(key, blocks))
    rows = rows.join(F.broadcast(held.toDF("held_block", "held_words")), F.col("filter_block") == F.col("held_block"), "left")
    bit = lambda place: F.getbit(F.get("held_words", F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1
    passes = reduce(and_, [bit(place) for place in _bits(key)])
    return rows.withColumn(name, key.isNotNull() & F.coalesce(passes, F.lit(False))).drop("filter_block", "held_block", "held_words")
