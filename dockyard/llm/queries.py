"""The operators' registered queries: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm import bpe, divergence, embeddings, exact_dedup, host_rules, language, merkle, ngram_jaccard, packing, quality, secrets, suffix_tree, token_counts
from dockyard.llm.tables import read, tokenizer_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read(spark, sf_dir, "documents")).drop("row")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(read(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_rows(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", F.col("score"), "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), digests=True)


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


_ALL = (
    op1_exact_dedup, op2_embedding_dedup, op3_suffix_tree, op4_secret_scans, op5_ngram_jaccard, op6_language_id,
    op7_best_fit_packing, op8_quality_classifier, op9_token_counts, op10_byte_bpe, op11_host_rules, op12_merkle_manifest,
    op13_source_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}
