from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from leadlane.llm import warc
from leadlane.llm.common import file_tasks
from leadlane.sources.staging import Workspace

SCHEMA = "page_id long, url string, html string"


def expected(pages):
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        ids = [p for p in groups[data] if p is not None]
        first = min(ids) if ids and len(groups[data]) > 1 and len(data) >= 100 else None
        response = first is None or page == first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def rows_of(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_round_trip(spark):
    long = "<p>é</p>" * 20
    pages = [
        (1, "u", None), (2, None, ""), (3, "u\r\nX: y", "short"), (4, "u", "short"), (9, "u", long), (5, "u", long), (7, "u", long),
        (5, "u", long), (None, "u", long), (None, "u", "n" * 200), (None, "v", "n" * 200), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 9), (11, "u", "x" * 3_000_000),
    ]
    table = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 AS digest", "'q' AS record_type")
    files = warc.write_archives(table, file_bytes=500)
    records = warc.read_archives(files)
    assert rows_of(records) == expected(pages)
    assert warc.gaps(records).collect() == [] and files.count() > 1
    payloads = {r["page_id"]: r["payload"] for r in records.collect() if r["record_type"] == "response"}
    assert payloads[5] == long.encode() and payloads[1] == b""
    nothing = warc.write_archives(table.limit(0))
    assert nothing.count() == 0 and warc.read_archives(nothing).collect() == []


def test_ids_keep_the_type_they_were_written_with(spark):
    long = "<p>same</p>" * 20
    pages = [("b-2", "u", long), ("a-1", "u", long), ("c", None, "short"), (None, "u", None)]
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, SCHEMA.replace("long", "string"))))
    assert records.schema["page_id"].dataType.simpleString() == "string"
    assert rows_of(records) == expected(pages)


def test_a_task_reads_several_of_very_many_files(spark):
    many = spark.range(1_000_000).selectExpr("concat('a/', id) AS path", "32L << 20 AS bytes")
    plans = [warc.read_archives(t)._jdf.queryExecution().optimizedPlan().toString() for t in (many, many.select("path"), many.limit(7))]
    assert "], 15625" in plans[0] and "], 15625" in plans[1] and "], 7" in plans[2]
    assert [file_tasks(n, b) for n, b in ((0, 0), (1, 1 << 40), (4096, 0), (5000, 0), (800_000, 100 << 40))] == [1, 1, 4096, 4096, 51200]


def test_query(spark):
    from leadlane.llm.queries import op2_warc

    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(op2_warc(spark, sf)) == expected(pages)


def some_records(rng, n):
    out = []
    for k in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(0, 400)))
        out.append(warc.make_record(k, "u", payload, hashlib.sha256(payload).hexdigest(), len(payload), None, True))
    return out


def test_salvage_after_damage():
    rng = random.Random(7)
    for packed in (True, False):
        for _ in range(60):
            records = some_records(rng, 8)
            members = [warc.gzip_member(r) if packed else r for r in records]
            bounds, at = [], 0
            for m in members:
                bounds.append((at, at + len(m)))
                at += len(m)
            data = bytearray(b"".join(members))
            hit = sorted(rng.sample(range(8), rng.randint(0, 3)))
            for k in hit:
                a, b = bounds[k]
                for _ in range(rng.randint(1, 5)):
                    data[rng.randrange(a, b)] ^= 1 << rng.randrange(8)
            found = list(warc.salvage(bytes(data)))
            places = [x if isinstance(x, tuple) else (x.offset, x.end) for x in found]
            assert [a for a, _ in places] == [0, *(b for _, b in places[:-1])] and places[-1][1] == len(data)
            good = {(x.offset, x.end) for x in found if not isinstance(x, tuple)}
            assert {bounds[k] for k in range(8) if k not in hit} <= good


def test_cut_and_padded_files():
    records = [warc.gzip_member(r) for r in some_records(random.Random(1), 4)]
    data = b"junk" + records[0] + b"\x1f\x8b\x08between" + records[1] + records[2] + records[3][:-9]
    found = list(warc.salvage(data))
    assert [isinstance(x, tuple) for x in found] == [True, False, True, False, False, True]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"\x1f\x8b\x08")) == [(0, 3)]


def test_damaged_files_are_logged(spark):
    workspace = Workspace(spark)
    payloads = [f"page {k} ".encode() * 20 for k in range(5)]
    records = [warc.make_record(k, "u", p, hashlib.sha256(p).hexdigest(), len(p), None, True) for k, p in enumerate(payloads)]
    wrong = warc.make_record(9, "u", b"x" * 50, hashlib.sha256(b"y").hexdigest(), 50, None, True)
    members = [warc.gzip_member(r) for r in [*records, wrong]]
    members[2] = members[2][:30] + b"\x00" * 10 + members[2][40:]
    store, inner = warc.file_system(workspace.root)
    store.create_dir(inner, recursive=True)
    with store.open_output_stream(f"{inner}/a.warc.gz", compression=None) as out:
        out.write(b"".join(members))
    read = warc.read_archives(spark.createDataFrame([(f"{workspace.root}/a.warc.gz",)], "path string"))
    assert sorted(r["page_id"] for r in read.collect() if r["record_type"] == "response") == [0, 1, 3, 4]
    begin = len(members[0]) + len(members[1])
    logged = sorted((r["offset"], r["end"]) for r in warc.gaps(read).collect())
    total = sum(map(len, members))
    assert logged == [(begin, begin + len(members[2])), (total - len(members[5]), total)]


def test_query_agrees_with_its_sql(spark):
    import duckdb
    from compare import differences

    from leadlane.llm.queries import SQL, op2_warc

    sf = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    assert differences(op2_warc(spark, sf), connection, SQL["op2_warc"]) == ""
