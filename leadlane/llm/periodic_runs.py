"""Periodic runs of words by internal pattern matching.

The words of a slice of texts become one array of numbers, texts kept apart by numbers of their own. A block is a
dyadic piece of that array, of 2, 4, 8, ... words at a multiple of its length. Prefix doubling yields the suffix array,
and on the way, for every block, the range of the suffix array that holds the block's occurrences. A wavelet tree over
the suffix array answers range successor queries: the nearest occurrence behind the block and in front of it. Each that
starts less than a block's length away is the next term of a progression whose difference is a candidate period.

A run of period q with at least ``4 * q`` words (6 for q = 1) holds a whole block of the length m with q < m <= 2 q that
lies at least q words from one end of the run. As the period is the smallest one, the nearest occurrence on that side
starts exactly q words away. So no run is missed. A nearest occurrence is never a multiple of a smaller period either.
Blocks of one run name the same period and touch, so they are merged; what is left at the ends is shorter than a block
and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import slices

#: A run has at least this many words, and at least this many periods; the method needs 4 periods and 6 words.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Bytes of text whose words are put into one array; a longer text has an array of its own.
ARRAY_BYTES = 1 << 20

RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class WaveletTree:
    """Range successor over an array of numbers from 0 up: a bit vector with a rank directory per binary digit.

    Bit vectors are held as 64-bit words with the number of ones before each, so a tree needs some 1.5 bits per number
    and digit. Queries take arrays and work on all of them at once.
    """

    def __init__(self, values: np.ndarray):
        self.digits = max(int(values.max(initial=0)).bit_length(), 1)
        self.n = len(values)
        self.levels = []
        for digit in reversed(range(self.digits)):
            bits = (values >> digit) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])
            zeros = self.n - int(bits.sum())
            self.levels.append((words, before, zeros))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        whole, rest = at >> 6, (at & 63).astype(np.uint64)
        part = words[whole] & ((np.uint64(1) << rest) - np.uint64(1))
        return before[whole] + np.bitwise_count(part)

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of the places ``low`` to ``high`` (not included) are smaller than ``bound``."""
        found = np.zeros(len(low), np.int64)
        for (words, before, zeros), digit in zip(self.levels, reversed(range(self.digits))):
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            one = (bound >> digit) & 1 == 1
            found += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number with ``rank`` (from 0) in the sorted numbers of the places ``low`` to ``high``."""
        value = np.zeros(len(low), np.int64)
        for words, before, zeros in self.levels:
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            n_zeros = (high - b) - (low - a)
            one = rank >= n_zeros
            rank = np.where(one, rank - n_zeros, rank)
            value = 2 * value + one
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return value

    def neighbours(self, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest smaller and larger number in the range around ``at``, which is in it; -1 where there is none."""
        rank = self.count_below(low, high, at)
        smaller, larger = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        some = rank > 0
        smaller[some] = self.smallest(low[some], high[some], rank[some] - 1)
        some = rank + 1 < high - low
        larger[some] = self.smallest(low[some], high[some], rank[some] + 1)
        return smaller, larger


def block_ranges(codes: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and per block length the blocks that occur again with their ranges in it.

    ``codes`` are numbers from 0 up; ``longest`` bounds the length of blocks. Suffixes that agree in more words than the
    longest block stay in any order, which no block's range depends on.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    fresh = np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    size = np.diff(np.concatenate([np.flatnonzero(fresh), [n]]))
    # Places in the suffix array whose suffixes are not yet told apart.
    open_at = np.flatnonzero(np.repeat(size, size) > 1)
    found, m = [], 1
    while len(open_at) and 2 * m <= longest:
        suffixes = order[open_at]
        follow = np.where(suffixes + m < n, rank[np.minimum(suffixes + m, n - 1)], -1)
        group = rank[suffixes]
        sort = np.lexsort((follow, group))
        suffixes, follow, group = suffixes[sort], follow[sort], group[sort]
        order[open_at] = suffixes
        fresh = np.ones(len(open_at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        begins = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([begins, [len(open_at)]]))
        low = np.repeat(open_at[begins], size)
        rank[suffixes] = low
        m *= 2
        again = np.repeat(size, size) > 1
        at_block = again & (suffixes % m == 0) & (suffixes + m <= n)
        found.append((m, suffixes[at_block], low[at_block], low[at_block] + np.repeat(size, size)[at_block]))
        open_at = open_at[again]
    return order, found


def _merged(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same period that touch or overlap, as one."""
    sort = np.lexsort((start, period))
    start, stop, period = start[sort], stop[sort], period[sort]
    # Ends so far within a period: periods are set apart by an offset larger than any place.
    apart = (period - period.min(initial=0)) * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + apart)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] + apart[1:] > reach[:-1]
    begins = np.flatnonzero(fresh)
    ends = np.concatenate([begins[1:], [len(start)]]) - 1
    return start[begins], reach[ends] - apart[ends], period[begins]


def _extend(codes: np.ndarray, a: int, b: int, period: int) -> tuple[int, int]:
    """The longest stretch around [a, b) in which every word equals the one ``period`` words on."""
    step = 16
    while a > 0:
        low = max(0, a - step)
        differs = np.flatnonzero(codes[low:a] != codes[low + period : a + period])
        if len(differs):
            a = low + int(differs[-1]) + 1
            break
        a, step = low, 2 * step
    step, last = 16, len(codes) - period
    while b < last:
        high = min(last, b + step)
        differs = np.flatnonzero(codes[b:high] != codes[b + period : high + period])
        if len(differs):
            b += int(differs[0])
            break
        b, step = high, 2 * step
    return a, b


def find_in_codes(codes: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Runs of an array of numbers as rows (start, length, period), by start, then period.

    ``longest`` is the length of the longest stretch that a run can lie in.
    """
    none = np.zeros((0, 3), np.int64)
    if longest < least_words:
        return none
    # A period is at most a fourth of its run, and its block is at most two periods long.
    suffixes, found = block_ranges(codes, max(2, longest // 2))
    if not found or not sum(len(at) for _, at, _, _ in found):
        return none
    length = np.concatenate([np.full(len(at), m, np.int64) for m, at, _, _ in found])
    at, low, high = (np.concatenate([part[k] for part in found]) for k in (1, 2, 3))
    before, behind = WaveletTree(suffixes).neighbours(low, high, at)
    near_behind, near_before = (behind >= 0) & (behind - at < length), (before >= 0) & (at - before < length)
    start = np.concatenate([at[near_behind], before[near_before]])
    period = np.concatenate([(behind - at)[near_behind], (at - before)[near_before]])
    reach = np.concatenate([length[near_behind], length[near_before]])
    if not len(start):
        return none
    start, stop, period = _merged(start, start + reach, period)
    # Less than a block, at most two periods, can be added on either side.
    may = stop - start + 5 * period >= np.maximum(least_words, least_periods * period)
    runs = set()
    for a, b, q in zip(start[may].tolist(), stop[may].tolist(), period[may].tolist()):
        a, b = _extend(codes, a, b, q)
        if b - a + q >= max(least_words, least_periods * q):
            runs.add((a, b - a + q, q))
    return np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the texts in the list of all their words, and the words."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0D]+")
    offsets, words = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return before[offsets], words.filter(pa.array(real))


def runs_of_texts(texts: pa.Array, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """Offsets and words of some texts, and the runs of each."""
    offsets, words = _words(texts)
    n_words = np.diff(offsets)
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    # A number of its own behind every text, so that no block that reaches across occurs twice.
    which = np.repeat(np.arange(len(n_words)), n_words)
    codes = np.empty(len(numbers) + len(n_words), np.int64)
    codes[np.arange(len(numbers)) + which] = numbers
    codes[offsets[1:] + np.arange(len(n_words))] = len(coded.dictionary) + np.arange(len(n_words))
    found = find_in_codes(codes, int(n_words.max(initial=0)), least_words, least_periods)
    begins = offsets[:-1] + np.arange(len(n_words))
    of_text = np.searchsorted(begins, found[:, 0], "right") - 1
    found[:, 0] -= begins[of_text]
    cut = np.searchsorted(of_text, np.arange(len(n_words) + 1))
    return offsets, words, [found[a:b] for a, b in zip(cut, cut[1:])]


def _collapsed(words: pa.Array, runs: np.ndarray) -> str:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    return " ".join(words.filter(pa.array(kept)).to_pylist())


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words stand between spaces and the control characters tab to carriage return. ``runs`` lists (start, length, period)
    by start, then period: every longest stretch of words, numbered from 0, with this smallest period and at least
    ``least_words`` (6 or more) words and ``least_periods`` (4 or more) periods. ``collapsed`` holds the words that no run
    contains behind its first period, joined by spaces.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are judged one by one, so
    repeated rows give equal rows and null ids stay null; runs that start together come with the shorter period first.
    Other columns are not read, an empty table gives an empty result, and nothing is shuffled. A slice of texts, or one
    longer text, is held at a time with some 60 bytes per word.
    """
    if least_words < LEAST_WORDS or least_periods < LEAST_PERIODS:
        raise ValueError(f"The method finds runs of at least {LEAST_WORDS} words and {LEAST_PERIODS} periods")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", ARRAY_BYTES):
            offsets, words, found = runs_of_texts(part.column("text"), least_words, least_periods)
            texts = []
            for a, b, runs in zip(offsets.tolist(), offsets[1:].tolist(), found):
                texts.append(_collapsed(words.slice(a, b - a), runs) if len(runs) else None)
            plain = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
            collapsed = pc.coalesce(pa.array(texts, pa.string()), pc.binary_join(plain, " ").cast(pa.string()))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            ends = np.cumsum([0, *map(len, found)])
            runs = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUNS_ARROW.value_type)),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_words long, runs {RUNS_TYPE}, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """``doc_id``, number of runs, the longest run (then the first, then of the shorter period) and hashes of the results."""
    best = F.expr("array_min(transform(runs, r -> named_struct('l', -r.length, 'start', r.start, 'period', r.period)))")
    line = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    length = -F.col("best.l")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.l div best.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
