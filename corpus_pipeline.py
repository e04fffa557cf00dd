"""A corpus pipeline of five text operators; every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents as they came, extra columns of any name among them: the operators work beside a struct of
the whole row. An empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe_codec, decontaminate, language_id, secret_scan, simhash_dedup
from shelfmark.llm.common import cut, discard, temporary
from shelfmark.llm.queries import VOCABULARY


def _beside(docs: DataFrame, *needed: str) -> DataFrame:
    """The rows as structs, and the columns that an operator needs."""
    return docs.select(F.struct(*docs.columns).alias("row"), *needed)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; ``lang`` becomes the prediction. Repeated rows stay."""
    done = language_id.identify(_beside(docs, "doc_id", "text", "lang")).where(F.col("lang_pred") != language_id.UNKNOWN)
    return done.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.{c}") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest key stays, of a key's texts in it the one with the least hash. Rows with one key
    and different texts are different documents; of rows with one key and text the one whose row has the least hash stays; rows without a key stay."""
    keyed = docs.where("doc_id is not null")
    if keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        order = F.xxhash64(F.to_json(F.struct(*docs.columns)))
        keyed = cut(keyed.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*"), "one-row-a-document")
    groups = simhash_dedup.near_groups(keyed.select("doc_id", "text"))
    least = F.min(F.struct("doc_id", "tie")).alias("least")
    kept = cut(groups.groupBy("group").agg(least).select(F.col("least.doc_id").alias("kept_key"), F.col("least.tie").alias("kept_tie")), "kept")
    # the keys grow with the documents, so they are shuffled at every size, small tables included
    same = (F.col("doc_id") == F.col("kept_key")) & (F.xxhash64("text") == F.col("kept_tie"))
    return keyed.join(kept.hint("merge"), same, "left_semi").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too large a part of benchmark items go. Repeated rows share their fate."""
    found = decontaminate.judge(decontaminate.find_items(_beside(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))
    return found.where(~F.col("contaminated")).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; ``n_chars`` follows the text."""
    return docs.withColumn("text", secret_scan.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and a hash of what they decode to."""
    done = bpe_codec.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: The first stage is a trained model and the second needs XXH64, which DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary() as made:  # what a stage wrote on its way goes once its result is written, and so does the stage before
            new = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(new)
        discard(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
