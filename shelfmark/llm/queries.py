"""Registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontaminate, embedding_dedup, importance, language_id, license_scan, phrase_dedup, secret_scan, simhash_dedup, spelling, stream_dedup, suffix_dedup, toxicity
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "VOCABULARY"]

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.classify(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digest(phrase_dedup.remove_phrases(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_items(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text")))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.digest(bpe_codec.encode_documents(docs, public_tokenizers.path(VOCABULARY)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.digest(importance.resample(docs, _table(spark, sf_dir, "benchmark").select("text")))


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.digest(stream_dedup.judge_copies(spark, f"{sf_dir}/documents.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.digest(spelling.group_variants(spelling.vocabulary(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_simhash_dedup, op3_language_id, op4_suffix_dedup, op5_embedding_dedup, op6_toxicity, op7_phrase_dedup, op8_decontaminate, op9_bpe_codec, op10_license_scan,
        op11_importance_resample, op12_stream_dedup, op13_spelling_variants,
    )
}
