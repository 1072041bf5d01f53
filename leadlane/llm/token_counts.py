"""Token counts of whole texts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import slices
from leadlane.llm.segments import encoder

SENTENCE_MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def count_tokens(docs: DataFrame, tokenizer: str = SENTENCE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``docs``.

    Texts reach the tokenizer in slices of about equal bytes, cut at safe boundaries; only numbers come back.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted one by one, null ids stay null, and
    other columns are not read. An empty table gives an empty result. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text")
            n_tokens, _ = encoder(tokenizer).encode(texts, want_ids=False)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``over_limit``: more tokens than ``limit``."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
