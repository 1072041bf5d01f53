"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is a row of zstandard frames, each with the ids of some whole documents, or part of a long one, as
little-endian unsigned numbers of 2 or 4 bytes. After them comes a skippable frame with the seek table: per frame
its compressed and uncompressed size and the first 32 bits of the XXH64 of its contents, then the number of frames,
a descriptor byte and a magic number, as in the public "zstd seekable format". Any zstandard tool can decompress the
file; a reader that wants some documents reads the table from the end and then only their frames.

Which document lies where is a table of its own (``index``), staged with the list of files. A task that runs twice
writes two files, of which only the one in the committed list is ever read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlane.llm.common import SLICE_BYTES, file_tasks, slices
from leadlane.llm.remote import file_system
from leadlane.llm.segments import encoder
from leadlane.sources.staging import Workspace

BYTE_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")

FRAME_BYTES = 1 << 20
FILE_BYTES = 64 << 20
LEVEL = 3


class FrameWriter:
    """Writes frames to an open binary file and ends it with the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.pending, self.size, self.entries, self.written = [], 0, [], 0
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    @property
    def position(self) -> int:
        """Uncompressed bytes so far."""
        return self.written + self.size

    def add(self, data: bytes) -> None:
        self.pending.append(data)
        self.size += len(data)
        while self.size >= self.frame_bytes:
            whole = b"".join(self.pending)
            self._frame(whole[: self.frame_bytes])
            self.pending, self.size = [whole[self.frame_bytes :]], len(whole) - self.frame_bytes

    def _frame(self, data: bytes) -> None:
        packed = self.codec.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(data)

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.pending))
            self.pending, self.size = [], 0
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        table += FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Reads byte ranges of the uncompressed contents, decompressing only the frames they touch."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("The file does not end in a seek table with checksums")
        table = self._bytes(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        self.entries = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        self.codec = zstandard.ZstdDecompressor()
        self.kept: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _bytes(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            data = self.codec.decompress(self._bytes(int(self.packed_at[k]), int(self.entries[k, 0])))
            if len(data) != self.entries[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries[k, 2]:
                raise ValueError(f"Frame {k} does not match its checksum")
            self.kept = (k, data)
            self.frames_read += 1
        return self.kept[1]

    def read(self, start: int, n: int) -> bytes:
        if not n:
            return b""
        first = int(np.searchsorted(self.at, start, "right")) - 1
        parts, end = [], start + n
        while start < end:
            data, base = self.frame(first), int(self.at[first])
            parts.append(data[start - base : end - base])
            start = base + len(data)
            first += 1
        return b"".join(parts)


@dataclass
class TokenFiles:
    """A written collection. ``index``: one row per document with its file, place and number of ids."""

    root: str
    index: DataFrame

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """``doc_id, start, n_tokens, ids`` from the files, for all documents or those with an id in ``wanted``.

        ``ids`` are little-endian unsigned 32-bit numbers. Documents keep the order of their file within a task, and
        a task reads a frame once. A frame that fails its checksum is an error. Thousands of files have a task each; more
        are dealt to tasks that read some of them after one another (``common.file_tasks``).
        """
        index = self.index
        if wanted is not None:
            index = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, source, reader = None, None, None
            for batch in batches:
                rows = batch.to_pydict()
                starts = rows["start"]
                parts: list[bytes] = []
                begin = size = 0
                for i, path in enumerate(rows["path"]):
                    if path != name:
                        if source:
                            source.close()
                        files, inner = file_system(path)
                        source, name = files.open_input_file(inner), path
                        reader = FrameReader(source, source.size())
                    width = rows["width"][i]
                    data = reader.read(rows["at"][i] * width, rows["n_tokens"][i] * width)
                    parts.append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
                    size += len(parts[-1])
                    if size >= SLICE_BYTES or i + 1 == batch.num_rows:
                        cut = batch.slice(begin, i + 1 - begin)
                        yield pa.RecordBatch.from_arrays(
                            [cut.column("doc_id"), pa.array(starts[begin : i + 1], pa.int64()), cut.column("n_tokens"), pa.array(parts, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        begin, parts, size = i + 1, [], 0
            if source:
                source.close()

        kind = index.schema["doc_id"].dataType.simpleString()
        # A given number of partitions is kept; otherwise the short index would be merged into a few tasks.
        files = index.groupBy("path").agg(F.sum(F.col("n_tokens") * F.col("width")).alias("bytes"))
        n_files, n_bytes = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        ordered = index.repartition(file_tasks(n_files, n_bytes), "path").sortWithinPartitions("path", "at")
        return ordered.select("doc_id", "start", "n_tokens", "path", "at", "width").mapInArrow(
            load, f"doc_id {kind}, start long, n_tokens long, ids binary"
        )


def write_token_files(
    docs: DataFrame,
    workspace: Workspace | None = None,
    tokenizer: str = BYTE_TOKENIZER,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
    frame_bytes: int = FRAME_BYTES,
) -> TokenFiles:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the documents' ids.

    Null texts are empty (one id). Null document ids come first; rows with equal ids are ordered by a hash of the text, and
    equal rows are interchangeable. Other columns are not read. An empty table gives no file and an empty index. Files hold
    about ``file_bytes`` before compression, a longer document included whole.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark)
    root = f"{workspace.root}/token-files"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = file_system(root)
        files.create_dir(inner, recursive=True)
        encode = encoder(tokenizer)
        writer, out, path, part = None, None, None, -1
        for piece in slices(batches, "text"):
            n_tokens, ids = encode.encode(piece.column("text"))
            width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
            at, paths, widths, parts = [], [], [], []
            begin = 0
            for n in n_tokens.tolist():
                if writer is None or writer.position >= file_bytes or width != file_width:
                    if writer:
                        writer.close()
                        out.close()
                    name, part, file_width = uuid.uuid4().hex, part + 1, width
                    path = f"{root}/{name}.zst"
                    out = files.open_output_stream(f"{inner}/{name}.zst", compression=None)
                    writer = FrameWriter(out, frame_bytes)
                at.append(writer.position // width)
                paths.append(path)
                widths.append(width)
                parts.append(part)
                writer.add(np.append(ids[begin : begin + n], np.uint32(end_id)).astype(f"<u{width}").tobytes())
                begin += n
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(n_tokens + 1),
                    pa.array(paths),
                    pa.array(parts, pa.int32()),
                    pa.array(at, pa.int64()),
                    pa.array(widths, pa.int32()),
                ],
                ["doc_id", "n_tokens", "path", "part", "at", "width"],
            )
        if writer:
            writer.close()
            out.close()

    ordered = rows.orderBy("doc_id", F.xxhash64("text"))
    written = ordered.mapInArrow(write, f"doc_id {kind}, n_tokens long, path string, part int, at long, width int")
    placed = workspace.stage(written.withColumn("task", F.spark_partition_id()), "token-index")
    # One short row per file; files of a task follow one another, and so do the tasks.
    per_file = placed.groupBy("task", "part").agg(F.sum("n_tokens").alias("file_tokens"))
    tasks = per_file.groupBy("task").agg(F.sum("file_tokens").alias("task_tokens"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("task_tokens").over(before), F.lit(0)).alias("task_start"))
    within = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.withColumn("file_start", F.coalesce(F.sum("file_tokens").over(within), F.lit(0))).join(tasks, "task")
    starts = workspace.stage(starts.select("task", "part", (F.col("file_start") + F.col("task_start")).alias("base")), "file-starts")
    index = placed.join(starts, ["task", "part"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "path", "at", "width"
    )
    return TokenFiles(root, index)
