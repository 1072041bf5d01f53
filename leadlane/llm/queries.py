"""Queries of the operators on the tables of a folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlane.llm import decontaminate, langid, licenses, line_chunks, merkle_manifest, neural_lm, order_minhash, packing, periodic_runs, quality, token_counts, token_files, warc
from leadlane.llm.common import SPACES, WORD, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read_table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))
    return records.filter("record_type != 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.count_tokens(read_table(spark, sf_dir, "documents")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = token_files.write_token_files(read_table(spark, sf_dir, "documents")).read()
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return neural_lm.LanguageModel(docs, neural_lm.held_out(F.col("doc_id"))).score()


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.remove_repeated_chunks(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "removed_chunks", "removed_lines", "emptied")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    unseen = langid.held_out(F.col("doc_id"))
    return langid.predict(docs, langid.fit(docs.filter(~unseen)), keep={"held_out": unseen})


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def repeat_planted_words(docs: DataFrame) -> DataFrame:
    """Documents chosen by a hash of their id repeat a stretch of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.split(F.trim(F.regexp_replace("text", SPACES, " ")), " ")
    n, g = F.col("n"), F.col("g")
    chosen = (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), words))
        .select("doc_id", "text", "words", F.size("words").cast("long").alias("n"), F.expr("h div 10").alias("g"))
        .withColumn("a", F.when(n > 0, g % n))
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    )
    repeated = F.expr("transform(sequence(0, cast(n - 1 AS int)), i -> words[cast(if(i < a, i, a + (i - a) % p) AS int)])")
    return chosen.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.find_runs(repeat_planted_words(read_table(spark, sf_dir, "documents"))))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.judge(licenses.scan_licenses(read_table(spark, sf_dir, "documents"))).drop("duty")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # Rows with an even hash of their id are received without their line breaks.
    received = merkle_manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit("")))
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, received)
    proofs = merkle_manifest.Manifest(docs, claim=claim).proofs()
    folded = proofs.withColumn("folded_root", merkle_manifest.fold(F.col("claim"), F.col("path")))
    proof = merkle_manifest.proof_hash(F.col("path")).alias("proof_sha256")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", verified)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_warc, op3_token_counts, op4_token_files, op5_neural_lm, op6_quality, op7_order_minhash, op8_line_chunks, op9_langid, op10_decontaminate, op11_periodic_runs, op12_licenses, op13_merkle_manifest)}
#: What SQL can say. Tokenizers, hashed models, alignment and packing it cannot; tests hold plain versions of those.
SQL: dict[str, str] = {
    "op2_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        sized AS (
            SELECT page_id, payload, octet_length(encode(payload)) AS n, min(page_id) OVER (PARTITION BY payload) AS first_id
            FROM payloads
        ),
        judged AS (SELECT *, n >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM sized)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
            CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN first_id END AS refers_to
        FROM judged
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE encoded AS (
            SELECT doc_id, source, text,
                concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front,
                replace(text, chr(10), '') AS received,
                -- A table-free crc32: a character's byte goes in, then eight shifts; its last bit is inverted at the end.
                list_reduce(
                    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[],
                    lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END,
                    4294967295::BIGINT
                ) & 1 = 1 AS altered
            FROM documents
        ),
        leaves AS (
            SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(front || CASE WHEN altered THEN coalesce(strlen(received) || ':' || received, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claim
            FROM encoded
        ),
        placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
        ),
        nodes AS (
            SELECT 0 AS lvl, source, pos, leaf AS d, n FROM placed
            UNION ALL
            SELECT lvl + 1, source, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY lvl, source, pos // 3, n
        ),
        runs AS MATERIALIZED (SELECT lvl, source, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM nodes WHERE n > 1 GROUP BY ALL),
        subroots AS MATERIALIZED (
            SELECT source, d AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
        ),
        upper_nodes AS (
            SELECT 0 AS lvl, pos, subroot AS d, n FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 3, n
        ),
        upper_runs AS MATERIALIZED (SELECT lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM upper_nodes WHERE n > 1 GROUP BY ALL),
        walk AS (
            SELECT doc_id, 0 AS lvl, source, pos, n, leaf, '' AS proof, claim AS folded FROM placed
            UNION ALL
            SELECT w.doc_id, w.lvl + 1, w.source, w.pos // 3, (w.n + 2) // 3, w.leaf,
                w.proof || array_to_string(r.ds[1 : w.pos % 3], '') || array_to_string(r.ds[w.pos % 3 + 2 :], ''),
                sha256(array_to_string(r.ds[1 : w.pos % 3], '') || w.folded || array_to_string(r.ds[w.pos % 3 + 2 :], ''))
            FROM walk w JOIN runs r ON r.lvl = w.lvl AND r.source IS NOT DISTINCT FROM w.source AND r.run = w.pos // 3
            WHERE w.n > 1
        ),
        upper_walk AS (
            SELECT w.doc_id, 0 AS lvl, s.pos, s.n, w.leaf, s.subroot, w.proof, w.folded
            FROM walk w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
            UNION ALL
            SELECT w.doc_id, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, w.leaf, w.subroot,
                w.proof || array_to_string(r.ds[1 : w.pos % 3], '') || array_to_string(r.ds[w.pos % 3 + 2 :], ''),
                sha256(array_to_string(r.ds[1 : w.pos % 3], '') || w.folded || array_to_string(r.ds[w.pos % 3 + 2 :], ''))
            FROM upper_walk w JOIN upper_runs r ON r.lvl = w.lvl AND r.run = w.pos // 3
            WHERE w.n > 1
        )
        SELECT w.doc_id, w.leaf, w.subroot, top.d AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = top.d AS verified
        FROM upper_walk w, (SELECT d FROM upper_nodes WHERE n = 1) AS top WHERE w.n = 1
    """,
}
