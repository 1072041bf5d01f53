"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that an Arrow function handles at a time.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine; tasks call it where they run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Keep tokenizer libraries to the one core that a task owns."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


#: Up to this many files each have a task of their own; beyond, tasks hold about so many bytes of files.
FEW_FILES = 4096
TASK_BYTES = 2 << 30


def file_tasks(n_files: int, n_bytes: int) -> int:
    """Tasks that read a number of files with a number of bytes in all; each file is read by one task."""
    return max(min(n_files, max(FEW_FILES, -(-n_bytes // TASK_BYTES))), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null, empty or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text, in order."""
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def give_back() -> None:
    """Return memory that Arrow and the C library hold unused to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def in_clean_worker(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that begins without what other work left in its Python worker, and leaves nothing unused.

    Workers live on from stage to stage. A tokenizer and the segments it remembers pay off from task to task of its own
    stage only; beside the work of another they would just take memory.
    """

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if segments := sys.modules.get("leadlane.llm.segments"):
            segments.encoder.cache_clear()
        give_back()
        yield from function(batches)
        give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of a text column, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
            # Workers live on from stage to stage; what a slice needed goes back to the machine.
            pa.default_memory_pool().release_unused()


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values of a list column of numbers; null lists are empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar([], column.type))
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)
