"""The corpus operators' queries: each applies its operator to the whole table, and derives digests from its output."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bagminhash, byte_bpe, exact, iblt, orc_tokens, packing, pii, quality, substrings, token_counts
from keystrata.llm.common import documents, scratch, text_of


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text_sha256", F.sha2(text_of().cast("binary"), 256))
    return exact.deduplicate(docs, columns=["doc_id", "text_sha256"])


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = orc_tokens.write_tokens(documents(spark, sf_dir), scratch(spark, "orc"), public_tokenizers.path("byte_bpe_50k.json"))
    return orc_tokens.with_crc(orc_tokens.with_start(files).select("doc_id", "start", "n_tokens", "ids"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    back = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), **how), **how)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.spans(docs, pii.train(docs)).select("doc_id", "base", "added")
    counts = [F.size(F.filter("base", partial(lambda k, c: c["kind"] == k, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.concat("base", "added")).alias("spans"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicate(documents(spark, sf_dir), columns=["doc_id"])


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_fingerprints": op2_fingerprints,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_orc_tokens": op4_orc_tokens,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_pii": op6_pii,
    "op7_bagminhash": op7_bagminhash,
    "op8_best_fit": op8_best_fit,
    "op9_token_counts": op9_token_counts,
    "op10_substrings": op10_substrings,
}
SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
    """,
}
