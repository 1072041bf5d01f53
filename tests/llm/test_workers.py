"""What Python workers hold while stages follow each other in one session."""

import pyarrow as pa
import pytest

from leadlane.llm import line_chunks, order_minhash, packing, segments

TEXT = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    "function, columns",
    [
        (line_chunks._passage_hashes, {"k1": pa.array([1]), "k2": pa.array([2]), "doc_id": pa.array([3]), "text": pa.array([TEXT])}),
        (order_minhash._describe, {"doc_id": pa.array([1]), "h1": pa.array([1]), "h2": pa.array([2]), "words": pa.array([[5, 6, 7]], pa.list_(pa.int64()))}),
        (order_minhash._by_group(lambda rows: [], ("a",)), {"part": pa.array([1, 1])}),
        (order_minhash._align(0.8), {c: pa.array([v]) for c, v in {"node": 1, "leader": 2, "words_a": "a b", "words_b": "a b"}.items()}),
    ],
)
def test_work_without_a_tokenizer_drops_what_workers_hold(function, columns):
    segments.encoder(packing.WORD_TOKENIZER).encode(pa.array([TEXT]))
    assert segments.encoder.cache_info().currsize == 1
    assert list(function(iter([pa.RecordBatch.from_pydict(columns)])))
    assert segments.encoder.cache_info().currsize == 0


def test_no_workers_for_lists_of_rows(spark):
    """Spark turns a list of rows into a table in Python workers of another kind, which stay beside those of Arrow."""
    cut = spark.range(50).selectExpr("id", "id % 7 + 1 AS length")
    packed = packing.pack(cut, 16)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert packed.count() == 50
    assert packing.pack(cut.limit(0), 16).count() == 0
    found = order_minhash.NearDuplicates(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"))
    assert "ExistingRDD" not in found.links._jdf.queryExecution().toString()
    assert found.links.count() == 0
