"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are lower-cased and everything but letters and digits becomes one space. A benchmark item is a row of
windows that start every few bytes; a document holds the item if it holds a window with at most ``errors`` of its
bytes edited. A window of m bytes found with e edits shares at least m + 1 - q(e + 1) q-grams with the document, all
within e diagonals. So the shared q-grams are listed per item in bands of diagonals that overlap by more than e, the
windows are counted on these lists, and only those that reach the bound are aligned. Nothing that meets the budget is
missed. Short items count only as a whole, letter for letter, between word boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.llm.alignment import best_within
from leadlane.llm.common import in_clean_worker, slices

Q = 8
WINDOW = 120
#: Bytes from one window's start to the next, so an excerpt with as many bytes less one beyond a window holds one.
STEP = 5
ERRORS = 0.1
#: Items with fewer bytes after normalisation are found only letter for letter.
LEAST_BYTES = 48
#: Benchmark text that is searched for in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 2 << 20

_OTHER = re.compile(r"[\W_]+")
_HASH_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Between two texts of a batch: more bytes than a window may have edits.
_GAP = b"\x00" * 64


def normalise(text: str | None) -> bytes:
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def _qgrams(data: bytes) -> np.ndarray:
    """The q bytes at every place of ``data`` as one number each."""
    return np.ndarray((max(len(data) - Q + 1, 0),), "<u8", data, strides=(1,)).astype(np.uint64)


def _places(codes: np.ndarray) -> np.ndarray:
    places = codes * _MULTIPLIER
    places >>= np.uint64(64 - _HASH_BITS)
    return places


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each comes."""
    keys = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edges], np.diff(np.append(edges, len(keys)))


@dataclass
class Windows:
    """Windows of the items of one block and an index of the items' q-grams.

    Items of one and a half windows or less are also a window as a whole. Short items are one window without a budget,
    with a space at both ends; those too short for a q-gram are held only by a text that is nothing else.
    """

    items: list
    window: int = WINDOW
    errors: float = ERRORS

    def __post_init__(self):
        self.parts, self.part_items, self.equal = [], [], {}
        spans = []
        for item, text in self.items:
            n, short = len(text), len(text) < LEAST_BYTES
            if not n:
                continue
            if n + 2 < Q:
                self.equal.setdefault(text, []).append(len(spans))
            part, size = len(self.parts), min(n, self.window)
            self.parts.append(b" " + text + b" " if short else text)
            self.part_items.append(item)
            if short or n <= self.window * 3 // 2:
                spans.append((part, 0, n + 2 * short, 0 if short else min(int(self.errors * n), (n - Q) // Q)))
            if not short and n > self.window:
                budget = min(int(self.errors * size), (size - Q) // Q)
                spans += [(part, start, size, budget) for start in sorted({*range(0, n - size + 1, STEP), n - size})]
        spans = np.array(spans, np.int64).reshape(-1, 4)
        self.part_of, self.starts, self.sizes, self.budgets = spans.T.copy()
        self.bounds = self.sizes + 1 - Q * (self.budgets + 1)
        self.band = int(self.budgets.max(initial=0)) + 1
        self.first_window = np.searchsorted(self.part_of, np.arange(len(self.parts) + 1))
        heads = self.first_window[:-1]
        self.least = np.maximum(np.minimum.reduceat(self.bounds, heads), 1) if len(heads) else heads
        self.reach = np.maximum.reduceat(self.sizes, heads) - Q if len(heads) else heads
        #: More than any place in an item and than a band on either side.
        self.span = max(map(len, self.parts), default=0) + 2 * self.band
        codes = [_qgrams(t) for t in self.parts]
        of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.of, self.at = of[order], at[order]
        self.filter = np.zeros(1 << _HASH_BITS, bool)
        self.filter[_places(self.codes)] = True

    @property
    def item_of(self) -> list:
        """The item of every window."""
        return [self.part_items[k] for k in self.part_of.tolist()]

    @property
    def texts(self) -> list[bytes]:
        return [self.text(k) for k in range(len(self.starts))]

    def text(self, k: int) -> bytes:
        start = self.starts[k]
        return self.parts[self.part_of[k]][start : start + self.sizes[k]]

    def candidates(self, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """The first diagonal, from the item's start, of every band in which windows reach their bounds, and these."""
        codes = _qgrams(data)
        if not len(codes) or not len(self.codes):
            return
        hit = np.flatnonzero(self.filter[_places(codes)])
        entry = np.searchsorted(self.codes, codes[hit])
        entry = np.minimum(entry, len(self.codes) - 1)
        same = self.codes[entry] == codes[hit]
        hit, entry = hit[same], entry[same]
        counts = self.first[entry + 1] - self.first[entry]
        total = np.cumsum(counts)
        posting = np.repeat(self.first[entry] - total + counts, counts) + np.arange(counts.sum())
        part, at = self.of[posting], self.at[posting]
        block = (np.repeat(hit, counts) - at + self.span) // self.band
        # A q-gram of the item counts once per band, however often the text repeats it. Every hit lies in two
        # bands: the one that starts at its block, and the one before.
        width = (len(data) + self.span) // self.band + 2
        key = (part * width + block) * self.span + at
        key, _ = _distinct(np.concatenate([key, key - self.span]))
        if not len(key):
            return
        group, at = key // self.span, key % self.span
        # Somewhere in a good band, as many q-grams as the item's lowest bound lie within its longest window.
        last = np.arange(len(key)) + self.least[group // width] - 1
        end = np.minimum(last, len(key) - 1)
        good = (last == end) & (group[end] == group) & (at[end] - at <= self.reach[group // width])
        for g in np.unique(group[good]).tolist():
            a, b = np.searchsorted(group, [g, g + 1])
            low, high = self.first_window[g // width], self.first_window[g // width + 1]
            starts, shared = self.starts[low:high], at[a:b]
            n = np.searchsorted(shared, starts + self.sizes[low:high] - Q, "right") - np.searchsorted(shared, starts)
            yield (g % width) * self.band - self.span, low + np.flatnonzero(n >= self.bounds[low:high])

    def search(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(window, first byte, end, edits) of the best match of windows in every band that holds some.

        After a match, the next window tried starts half a window on, or is the item's last.
        """
        found = []
        for diagonal, windows in self.candidates(data):
            onward = 0
            for k in windows.tolist():
                start, budget = int(self.starts[k]), int(self.budgets[k])
                if start < onward and k != windows[-1]:
                    continue
                text, first = self.text(k), diagonal + start
                begin = max(first - budget, 0)
                region = data[begin : max(first + 2 * self.band + len(text) + budget, 0)]
                if best := best_within(text, region, budget):
                    edits, end = best
                    back = best_within(text[::-1], region[:end][::-1], edits)
                    found.append((k, begin + end - back[1], begin + end, edits))
                    onward = start + len(text) // 2
        return found

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, window, first byte, end, edits) of the matches in a batch of texts, searched as one."""
        begins = np.cumsum([1, *(len(t) + len(_GAP) + 2 for t in texts)])
        for k, a, b, edits in self.search(_GAP.join(b" " + t + b" " for t in texts)):
            row = max(int(np.searchsorted(begins, a + 1, "right")) - 1, 0)
            a, b, text = int(a - begins[row]), int(b - begins[row]), texts[row]
            budget = int(self.budgets[k])
            if self.parts[self.part_of[k]][:1] == b" ":  # the boundaries of a short item are no part of it either
                a, b = a + 1, b - 1
            elif budget and (a < 0 or b > len(text)):  # the spaces around a text are no part of it
                begin = max(a - budget, 0)
                best = best_within(self.text(k), text[begin : b + budget], budget)
                if not best:
                    continue
                edits, a, b = best[0], max(a, 0), begin + best[1]
            yield row, k, max(a, 0), min(b, len(text)), edits
        for row, text in enumerate(texts if self.equal else ()):
            for k in self.equal.get(text, ()):
                yield row, k, 0, len(text), 0


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The normalised items, about ``block_bytes`` of text at a time."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"], normalise(r["text"])) for r in part.collect()]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    errors: float = ERRORS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, n_windows, edits, start, end`` for every row of ``docs`` that holds part of an item.

    ``n_windows`` distinct windows of the item were found, at least half a window apart, the best with ``edits`` edits;
    ``start`` and ``end`` enclose all matches, in bytes of the normalised text. The benchmark is read in blocks of
    bounded size, each searched for in one pass over whole texts without a shuffle. Null and empty texts hold nothing.
    Items below ``LEAST_BYTES`` are found letter for letter between word boundaries, those below six bytes only if they
    are all of the text; null and empty items and those of punctuation only are in nothing. Equal document rows give
    equal result rows; equal items are told apart by their id only; null ids stay null. Other columns are not read.
    Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    schema = "doc_id {}, item_id {}, n_windows int, edits int, `start` long, `end` long".format(*kinds)

    def searcher(items: list):
        @in_clean_worker
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(items, window, errors)
            item_of = windows.item_of
            for part in slices(batches, "text", SLICE_BYTES):
                texts = [normalise(t) for t in part.column("text").to_pylist()]
                found: dict = {}
                for row, k, a, b, edits in windows.matches(texts):
                    found.setdefault((row, item_of[k]), []).append((k, a, b, edits))
                keys = sorted(found, key=lambda key: (key[0], str(key[1])))
                matches = [found[key] for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())),
                        pa.array([k[1] for k in keys], item_type),
                        pa.array([len({x[0] for x in m}) for m in matches], pa.int32()),
                        pa.array([min(x[3] for x in m) for m in matches], pa.int32()),
                        pa.array([min(x[1] for x in m) for m in matches], pa.int64()),
                        pa.array([max(x[2] for x in m) for m in matches], pa.int64()),
                    ],
                    ["doc_id", "item_id", "n_windows", "edits", "start", "end"],
                )

        return search

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    found = None
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        part = rows.mapInArrow(searcher(items), schema)
        found = part if found is None else found.unionAll(part)
    return found


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    errors: float = ERRORS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no part of an item, with all their columns as they are.

    The same search as in ``find_passages``, again without a shuffle: rows are let through batch by batch.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    text_at = inner[docs.columns.index(text_col)]

    def sieve(items: list):
        @in_clean_worker
        def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(items, window, errors)
            for part in slices(batches, text_at, SLICE_BYTES):
                texts = [normalise(t) for t in part.column(text_at).to_pylist()]
                clean = np.ones(len(texts), bool)
                for row, *_ in windows.matches(texts):
                    clean[row] = False
                yield part.filter(pa.array(clean))

        return let_through

    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        rows = rows.mapInArrow(sieve(items), rows.schema)
    return rows.toDF(*docs.columns)
