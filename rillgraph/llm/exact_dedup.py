"""Exact deduplication by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Each step keeps only the groups that still have two members; whole texts are hashed only in the groups that survive both
cheap steps. Of a group the smallest doc_id is kept (nulls last).

Plan: columnar storage has no way to a text's length or first characters but through the column of texts, so one scan takes both (12
bytes a row go on) and the refinement by length and by prefix runs on that table alone; a second scan, with the surviving
(length, prefix) groups as a broadcast or shuffled semi-join, hashes the texts of those groups, and only their hashes are
shuffled. Texts never are. Counts and minima combine before the shuffle, so a group of a third of all rows is one row a task.

Defined results: a null text duplicates nothing; empty texts equal each other; texts are compared as they are, so case and
spaces count; rows with null doc_id take part and lose against any id; a row that repeats (same id, same text) is one
document, of which exact_dedup keeps one row and duplicates() reports none; an empty table gives an empty result. Only
doc_id and text are read; other columns pass through exact_dedup unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PREFIX = 64


def refined(docs: DataFrame) -> DataFrame:
    """The rows in groups of equal text: doc_id, keep_id (smallest id of the group), _key (row_key)."""
    sized = docs.filter("text is not null").select("doc_id", "text", F.length("text").alias("_n"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("_p"))
    cheap = C.saved(sized.select("_n", "_p"))
    # most lengths of a large corpus occur twice; the map side combines them, so both counts shuffle little
    lengths = cheap.groupBy("_n").count().filter("count > 1").select("_n")
    heads = cheap.join(C.checked_broadcast(lengths, 24), "_n", "left_semi").groupBy("_n", "_p").count().filter("count > 1").select("_n", "_p")
    heads = C.saved(heads)
    full = sized.join(C.checked_broadcast(heads, 32), ["_n", "_p"], "left_semi").select("doc_id", "_n", F.unhex(F.sha2("text", 256)).alias("_sha"), C.row_key().alias("_key"))
    full = C.saved(full)
    groups = full.groupBy("_n", "_sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("_rows")).filter("_rows > 1").drop("_rows")
    return full.join(groups.hint("shuffle_hash"), ["_n", "_sha"]).select("doc_id", "keep_id", "_key")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) of every document whose text a smaller id has."""
    return refined(docs).filter("doc_id is not null and doc_id <> keep_id").select("doc_id", F.col("keep_id").alias("duplicate_of")).distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each text; null texts stay."""
    rows = C.saved(refined(docs))
    gone = rows.filter("not (doc_id <=> keep_id)").select("_key").distinct()
    kept = C.without(docs, gone)
    twice = C.saved(rows.filter("doc_id <=> keep_id").groupBy("_key").count().filter("count > 1").select("_key"))
    if twice.isEmpty():
        return kept
    at = C.fresh(docs)
    again = kept.withColumn(at, C.row_key()).join(C.checked_broadcast(twice.select(F.col("_key").alias(at)), 40), at, "left_semi")
    return C.without(kept, twice).unionByName(again.dropDuplicates([at]).drop(at))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, keep_id AS duplicate_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL)
WHERE doc_id <> keep_id GROUP BY doc_id, keep_id
"""
