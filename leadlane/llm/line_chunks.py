"""Repeated passages: content-defined chunks and windows of lines, removed after byte comparison.

A rolling hash over the hashes of the last lines decides where a chunk ends, so a passage is cut alike wherever it
stands and lines put in front of it shift nothing. A line of many words is a passage by itself and always stands
alone. Chunks of several lines, and such long lines, that come more than once in the corpus stay at their first place
(smallest document id, then place) and go everywhere else.

Windows find what chunks miss, as a chunk's ends may depend on what stands around it: from every line on, and back
from every line, the shortest run of lines that holds enough words. A run that comes again with that many words is
the union of such windows, so all of its lines go from the later places, wherever the chunks' boundaries fall. A line
goes only once its bytes have been compared with those of its counterpart at the first place.

Only hashes are shuffled for all passages. Texts travel once to find the repeated lines' bytes and once to be rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import in_clean_worker, slices
from leadlane.sources.staging import Workspace

#: Lines in the rolling window, and the mean number of lines from one boundary to the next.
WINDOW_LINES = 2
MEAN_LINES = 3
#: Words from which a line is a chunk of its own.
LONG_LINE_WORDS = 25
#: Words from which a run of lines that comes again is found whatever its boundaries.
RUN_WORDS = 50

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LEADING = pow(_BASE, WINDOW_LINES, 1 << 64)


def chunk_edges(lines: list[str], mean_lines: int = MEAN_LINES, long_words: int = LONG_LINE_WORDS) -> list[tuple[int, int, bool]]:
    """Chunks of a text as (first line, end, whether it may be removed).

    A chunk may be removed if it holds several lines with a word, or one line of at least ``long_words`` words.
    """
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    edges, start, rolling = [], 0, 0

    def close(end: int) -> None:
        nonlocal start
        if end > start:
            edges.append((start, end, sum(1 for x in lines[start:end] if x.strip()) > 1))
            start = end

    for i, (line, h) in enumerate(zip(lines, hashes)):
        rolling = rolling * _BASE + h
        if i >= WINDOW_LINES:
            rolling -= hashes[i - WINDOW_LINES] * _LEADING
        rolling &= _MASK
        if len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words:
            close(i)
            edges.append((i, i + 1, True))
            start = i + 1
        elif (rolling >> 20) % mean_lines == 0:
            close(i + 1)
    close(len(lines))
    return edges


def run_windows(lines: list[str], run_words: int = RUN_WORDS) -> set[tuple[int, int]]:
    """The shortest runs (first line, end) of at least ``run_words`` words from every line on and back from every line.

    Blank lines neither begin nor end a run.
    """
    words = [(i, n) for i, n in enumerate(len(line.split()) for line in lines) if n]
    found = set()
    for step in (1, -1):
        ahead, total = 0, 0
        order = words[::step]
        for i, n in order:
            while total < run_words and ahead < len(order):
                total += order[ahead][1]
                ahead += 1
            if total < run_words:
                break
            last = order[ahead - 1][0]
            found.add((min(i, last), max(i, last) + 1))
            total -= n
    return found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two hashes that stand for a document's id and text, nulls included."""
    return [
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
        F.xxhash64(F.col(text_col), F.lit(1), F.col(id_col)).alias("k2"),
    ]


@in_clean_worker
def _passage_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines and hash of every chunk that may be removed and of every window."""
    for part in slices(batches, "text"):
        rows, begins, ends, hashes = [], [], [], []
        for row, text in enumerate(part.column("text").to_pylist()):
            lines = (text or "").split("\n")
            digests = b"".join(map(xxhash.xxh128_digest, lines))
            for a, b in sorted({(a, b) for a, b, counts in chunk_edges(lines) if counts} | run_windows(lines)):
                rows.append(row)
                begins.append(a)
                ends.append(b)
                hashes.append(xxhash.xxh128_digest(digests[16 * a : 16 * b]))
        at = pa.array(rows, pa.int64())
        kept = [part.column(c).take(at) for c in ("k1", "k2", "doc_id")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.binary())],
            ["k1", "k2", "doc_id", "a", "b", "hash"],
        )


@in_clean_worker
def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the lines listed in ``lines``."""
    for part in slices(batches, "text"):
        rows, texts, numbers = [], [], []
        wanted = part.column("lines").to_pylist()
        for row, text in enumerate(part.column("text").to_pylist()):
            lines = (text or "").split("\n")
            for number in wanted[row]:
                rows.append(row)
                texts.append(lines[number])
                numbers.append(number)
        at = pa.array(rows, pa.int64())
        kept = [part.column(c).take(at) for c in ("k1", "k2")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["k1", "k2", "line", "bytes"]
        )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """Lines to remove: ``k1, k2`` of the document and the number of the ``line``."""
    workspace = workspace or Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_keyed(docs, id_col, text_col))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hashes = workspace.stage(
        rows.select("k1", "k2", "doc_id", "text").mapInArrow(
            _passage_hashes, f"k1 long, k2 long, doc_id {kind}, a int, b int, hash binary"
        ),
        "passage-hashes",
    )
    often = workspace.stage(hashes.groupBy("hash").count().filter("count > 1").select("hash"), "repeated-hashes")
    # Joins are merges at every size: what they shuffle then grows with the input alone.
    listed = workspace.stage(hashes.join(often.hint("merge"), "hash"), "repeated-passages")
    # The first place of a passage is reduced on the map side.
    first = F.min(F.struct("doc_id", "k1", "k2", "a", "b")).alias("first")
    firsts = workspace.stage(listed.groupBy("hash").agg(first), "first-places")
    own = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    # Every line of a later place and its counterpart; where both places overlap, the first one stays whole.
    line = F.explode(F.sequence(F.when(own, F.greatest("a", "first.b")).otherwise(F.col("a")), F.col("b") - 1)).alias("line")
    found = listed.join(firsts.hint("merge"), "hash").filter(~own | (F.col("b") > F.col("first.b")))
    found = found.select("k1", "k2", "a", "first", line)
    at = (F.col("first.a") + F.col("line") - F.col("a")).alias("at")
    found = found.groupBy("k1", "k2", "line").agg(F.min(F.struct("first.k1", "first.k2", at)).alias("to"))
    found = workspace.stage(found.select("k1", "k2", "line", F.col("to.k1").alias("f1"), F.col("to.k2").alias("f2"), "to.at"), "counterparts")
    wanted = found.select("k1", "k2", "line").unionAll(found.select("f1", "f2", "at"))
    wanted = workspace.stage(wanted.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line")).alias("lines")), "lines-by-document")
    texts = rows.join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "lines")
    texts = texts.mapInArrow(_line_texts, "k1 long, k2 long, line int, bytes string").distinct()
    texts = workspace.stage(texts, "repeated-lines")
    theirs = texts.toDF("f1", "f2", "at", "first_bytes")
    same = found.join(texts.hint("merge"), ["k1", "k2", "line"]).join(theirs.hint("merge"), ["f1", "f2", "at"])
    return workspace.stage(same.filter("bytes = first_bytes").select("k1", "k2", "line"), "lines-to-remove")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """``docs`` with all its columns, repeated passages cut out of the text, and three more columns.

    ``removed_chunks`` counts the unbroken runs of lines that went, ``removed_lines`` their lines; ``emptied`` tells that a text that had words has none
    left, because all of it stands elsewhere. Columns of those names are replaced. Null texts stay null and empty
    ones empty. Rows with equal id and text count as one document and are treated alike; a null id sorts first. An
    empty table gives an empty result. Texts without a repeated passage come back byte for byte.
    """
    added = ("removed_chunks", "removed_lines", "emptied")
    names = [c for c in docs.columns if c.lower() not in added]
    workspace = workspace or Workspace(docs.sparkSession)
    remove = repeated_lines(docs, id_col, text_col, workspace)
    listed = remove.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    listed = workspace.stage(listed, "removed-by-document")
    # Arrow functions take plain column names only; the table's own come back at the end.
    inner = [f"c{i}" for i in range(len(names))]
    text_at = inner[names.index(text_col)]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], *_keyed(docs, id_col, text_col))
    joined = rows.join(listed.hint("merge"), ["k1", "k2"], "left").drop("k1", "k2")

    @in_clean_worker
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_at):
            texts = part.column(text_at).to_pylist()
            counts, cut, emptied = [0] * len(texts), [0] * len(texts), [False] * len(texts)
            for row, numbers in enumerate(part.column("gone").to_pylist()):
                if not numbers:
                    continue
                numbers = set(numbers)
                counts[row], cut[row] = sum(n - 1 not in numbers for n in numbers), len(numbers)
                kept = [line for n, line in enumerate(texts[row].split("\n")) if n not in numbers]
                texts[row] = "\n".join(kept)
                emptied[row] = not texts[row].strip()
            columns = {c: part.column(c) for c in inner}
            columns[text_at] = pa.array(texts, pa.string())
            columns |= {"n_chunks": pa.array(counts, pa.int32()), "n_lines": pa.array(cut, pa.int32()), "emptied": pa.array(emptied)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(names, inner))
    out = joined.mapInArrow(rebuild, f"{kinds}, n_chunks int, n_lines int, emptied boolean")
    return out.toDF(*names, *added)
