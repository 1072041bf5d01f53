"""From raw documents to packed training sequences: five stages, each on all that the stage before it kept.

Every stage but the last returns the columns of its input. Rows go when the quality rules reject them, when line
dedup leaves nothing of their text, when another document of their near-duplicate group stays, or when they hold a
benchmark passage. Null texts and texts without words fail the quality rules; null ids pass through all stages;
columns with other names pass through untouched; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlane.llm import decontaminate, line_chunks, order_minhash, packing, quality
from leadlane.llm.common import read_table
from leadlane.sources.staging import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; ``n_chars``, where there is one, follows."""
    out = line_chunks.remove_repeated_chunks(docs).filter("NOT emptied")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Hashed n-grams, edit distances and packing cannot be said in SQL; the tests hold a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``: what the last stage returns."""
    workspace = Workspace(spark)
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = workspace.stage(docs, f"stage-{number + 1}")
    return docs
