"""The registered queries of this subpackage, and their SQL for DuckDB where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, ngram_join, packing, pii, search, secrets, sharding, token_output, toxicity
from .common import table

SHARDS = 40


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return search.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.balanced_tree(SHARDS), SHARDS)


def op3_bayes_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_plane_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_output.read_documents(token_output.encode_documents(table(spark, sf_dir, "documents"), path, end_id=0))


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.identify(documents, language_id.fit(documents))


def op7_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_documents(table(spark, sf_dir, "documents"))


def op8_cnn_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.scan_documents(documents, secrets.fit(documents))


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pivot_topk, op2_hash_tree_shards, op3_bayes_ngram_join, op4_decontamination, op5_plane_token_output, op6_crf_language_id,
        op7_pii_deobfuscation, op8_cnn_secret_scan, op9_cnn_toxicity, op10_nnls_packing,
    )
}

ORACLE_SQL = {"op1_pivot_topk": search.ORACLE, "op4_decontamination": decontamination.ORACLE}
