"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, exact_dedup, langid, licenses, packing, pii, sharding, simhash, sketch, token_files
from tallyframe.llm.common import scratch_path, table
from tallyframe.llm.tokens import default_path, tokenizer_pattern


def op1_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    found = langid.pages_language(table(spark, sf_dir, "pages"), model)
    return found.select(F.col("key").alias("page_id"), "lang", "confidence", "text_lang")


def op3_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), tokenizer_pattern(), end=2, tokens=1024)
    return packing.pack(cut, tokens=1024)


def op6_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.bounded_ring(table(spark, sf_dir, "documents"), shards=40, vnodes=128)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op9_bpe_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, default_path("byte_bpe_50k.json"), tokenizer_pattern(), end=0)
    return token_files.checked(spark, path)


QUERIES = {f.__name__: f for f in (op1_pii_boosted_candidates, op2_language_fusion, op3_license_patience, op4_scaled_sketch, op5_best_fit_packing, op6_bounded_ring_sharding, op7_simhash_near_dedup, op8_bloom_exact_dedup, op9_bpe_folds, op10_token_files)}

ORACLES = {
    "op8_bloom_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)""",
}
