"""Web archives: WARC records in gzip members, revisit records for repeated payloads, and a salvage reader.

The writer finds repeated payloads by their digests, writes one response per digest and refers the other pages to it.
Files hold one gzip member per record. The reader checks every member, every header and every digest. Where a check
fails it searches for the next member (or, in an uncompressed file, the next version line) from which a valid record
can be read, goes on from there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import file_tasks, slices
from leadlane.llm.remote import file_system
from leadlane.sources.staging import Workspace

#: Payloads below this size are always written in full.
LEAST_BYTES = 100
FILE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
#: Metadata of the list of files: the type of the page ids.
ID_TYPE = "page_id_type"

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSION_START = b"WARC/1."
MEMBER_START = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Largest member that the reader decompresses; a longer one is taken for damaged. It is the longest payload that a
#: Spark column can hold, and room for the headers, so the reader takes whatever the writer can write.
MEMBER_BYTES = (1 << 31) + (1 << 20)


def record_id(page_id) -> str:
    """The record id of a page; pages without id share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return VERSION + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + END


def _header_text(value: str | None) -> str:
    """A value that stays on its header line."""
    return " ".join((value or "").split())


def make_record(page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to, is_response: bool) -> bytes:
    kind = "response" if is_response else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _header_text(url))]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(n_bytes))]
    if page_id is not None:
        headers.append(("X-Page-Id", _header_text(str(page_id))))
    if is_response:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = http + payload
    else:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    return _record(headers, block)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block after its HTTP header."""
        return self.block.partition(END)[2]


def _parse(data: bytes, start: int, whole: bool) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record at ``start``; None if anything is not as it must be.

    ``whole``: nothing may follow the record in ``data``.
    """
    line_end = data.find(b"\r\n", start, start + 64)
    if not data.startswith(VERSION_START, start) or line_end < 0:
        return None
    head_end = data.find(END, line_end)
    if head_end < 0:
        return None
    headers = {}
    for line in data[line_end + 2 : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    begin = head_end + len(END)
    end = begin + int(length)
    if data[end : end + len(END)] != END or whole and end + len(END) != len(data):
        return None
    block = data[begin:end]
    digest = headers.get("warc-block-digest")
    if digest is not None and digest != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return None
    return headers, block, end + len(END)


def _member(data: bytes, start: int) -> tuple[bytes, int] | None:
    """Contents and end of the gzip member at ``start``; None if it is damaged or cut off."""
    unpacker, parts, size, at = zlib.decompressobj(31), [], 0, start
    try:
        while not unpacker.eof:
            chunk = unpacker.unconsumed_tail or data[at : at + 65536]
            if not chunk:
                return None
            if not unpacker.unconsumed_tail:
                at += len(chunk)
            parts.append(unpacker.decompress(chunk, 1 << 20))
            size += len(parts[-1])
            if size > MEMBER_BYTES:
                return None
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpacker.unused_data)


def _read_at(data: bytes, start: int) -> Record | None:
    """The valid record at ``start``, in a gzip member or bare."""
    if data.startswith(MEMBER_START, start):
        member = _member(data, start)
        parsed = member and _parse(member[0], 0, whole=True)
        return Record(start, member[1], parsed[0], parsed[1]) if parsed else None
    parsed = _parse(data, start, whole=False)
    return Record(start, parsed[2], parsed[0], parsed[1]) if parsed else None


def _next_start(data: bytes, start: int) -> int:
    """The next place at which a member or a version line may begin; the end of the data if there is none."""
    places = [p for p in (data.find(MEMBER_START, start), data.find(VERSION_START, start)) if p >= 0]
    return min(places, default=len(data))


def salvage(data: bytes) -> Iterator[Record | tuple[int, int]]:
    """All valid records of a file in order, and the gaps (first byte, end) between them."""
    at = 0
    while at < len(data):
        record = _read_at(data, at)
        if record:
            yield record
            at = record.end
            continue
        gap = at
        while at < len(data):
            at = _next_start(data, at + 1)
            record = _read_at(data, at) if at < len(data) else None
            if record:
                break
        yield gap, at
        if record:
            yield record
            at = record.end


def write_archives(
    pages: DataFrame,
    workspace: Workspace | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` and return the list of files: ``path, records, bytes``.

    The column ``path`` carries the type of the ids as metadata, for ``read_archives``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a response and the
    others are revisits that refer to it; all other rows are responses. Null html is an empty payload. Repeated rows
    of the smallest id are all responses. Null ids count as largest; if all ids of a group are null, its rows are
    responses. Other columns are not read. An empty table gives no file.
    """
    spark = pages.sparkSession
    workspace = workspace or Workspace(spark)
    root = f"{workspace.root}/archives"
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    equal = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    equal = workspace.stage(equal.filter("n > 1").select("digest", "first_id"), "repeated-payloads")
    known = rows.join(equal, "digest", "left")
    is_response = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    ready = known.withColumn("is_response", is_response).withColumn("payload", F.when(is_response, F.col("payload")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = file_system(root)
        files.create_dir(inner, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for part in slices(batches, "payload"):
            for r in part.to_pylist():
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{inner}/{name}", compression=None)
                payload = r["payload"] or b""
                data = gzip_member(make_record(r["page_id"], r["url"], payload, r["digest"], r["n_bytes"], r["first_id"], r["is_response"]))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((f"{root}/{name}", records, size))
        if out:
            out.close()
            done.append((f"{root}/{name}", records, size))
        columns = list(zip(*done)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "records", "bytes"])

    names = ("page_id", "url", "payload", "digest", "n_bytes", "first_id", "is_response")
    written = ready.select(*names).mapInArrow(write, "path string, records long, bytes long")
    listed = workspace.stage(written, "archive-list")
    kind = rows.schema["page_id"].dataType.simpleString()
    return listed.withColumn("path", F.col("path").alias("path", metadata={ID_TYPE: kind}))


def read_archives(files: DataFrame, id_type: str | None = None) -> DataFrame:
    """Records and gaps of the files in a table with a ``path`` column and, if known, a ``bytes`` column.

    Page ids get the type ``id_type``, else the one that the writer noted on ``path``, else long.

    Per record ``path, offset, end, record_type, page_id, payload, payload_bytes, payload_digest, refers_to``; size and
    digest are those of the full payload, computed from it for responses and taken from the header for revisits. A
    response whose payload does not match its payload digest is reported as a gap. Gaps have the type ``gap`` and
    only a place. A task holds one file at a time, each bounded in size by its writer. Thousands of files have a task each;
    more are dealt to tasks that read some of them after one another (``common.file_tasks``).
    """
    id_type = id_type or files.schema["path"].metadata.get(ID_TYPE, "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "offset", "end", "record_type", "page_id", "payload", "payload_bytes", "payload_digest", "refers_to")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], list(names))

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = file_system(path)
                with store.open_input_file(inner) as source:
                    data = source.read()
                rows, size = [], 0
                for found in salvage(data):
                    if not isinstance(found, tuple):
                        row = describe(found)
                        rows.append((path, found.offset, found.end, *row))
                        size += len(row[2] or b"")
                    else:
                        rows.append((path, *found, "gap", None, None, None, None, None))
                    if size >= (4 << 20):
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    schema = "path string, `offset` long, `end` long, record_type string, page_id string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    # A given number of partitions is kept; otherwise the short list would be merged into one task.
    size = F.col("bytes") if "bytes" in files.columns else F.lit(FILE_BYTES)
    n_files, n_bytes = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    records = files.select("path").repartition(file_tasks(n_files, n_bytes), "path").mapInArrow(read, schema)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def describe(record: Record) -> tuple:
    """``record_type, page_id, payload, payload_bytes, payload_digest, refers_to`` of a valid record.

    A payload that does not match its digest makes the record a gap.
    """
    headers = record.headers
    kind, page = headers.get("warc-type"), headers.get("x-page-id")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "response":
        length = headers.get("x-payload-length", "")
        return kind, page, None, int(length) if length.isdigit() else None, digest, headers.get("x-refers-to-page-id")
    payload = record.payload
    found = hashlib.sha256(payload).hexdigest()
    if digest and found != digest:
        return "gap", None, None, None, None, None
    return kind, page, payload, len(payload), found, None


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes: ``path, offset, end``."""
    return records.filter("record_type = 'gap'").select("path", "offset", "end")
