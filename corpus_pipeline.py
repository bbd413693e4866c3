"""A training corpus from raw documents: drop toxic documents, exact copies, near copies and benchmark leaks, then encode.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, which run() writes as Parquet to the
shared folder and reads again. All but the last return the columns of documents unchanged; the last adds token_ids,
n_tokens and round_trip. Nulls, empty texts, repeated rows, ties and empty tables have the results that the operators'
modules define: null and empty texts are never toxic, near copies or leaks, null texts no copies, empty texts copies of
each other; a row repeated as a whole is kept once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillgraph.llm import decontaminate, exact_dedup, sentencepiece_codec, simhash, toxicity
from rillgraph.shared import fresh_folder, removed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the classifier nor fingerprints, alignment and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage before wrote isn't read again
            removed(spark, f"{folder}/{k - 1}")
    return docs
