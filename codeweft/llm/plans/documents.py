"""Queries over documents: p8, p9, p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.bpe import encode_documents
from codeweft.llm.leaks import find_leaks
from codeweft.llm.truncation import truncation_scores
from codeweft.session import load


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encode_documents(load(spark, sf_dir, "documents"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the passage's length in words."""
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked evaluation items of each document."""
    return p9_passages(spark, sf_dir).select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents that leak it."""
    leaks = p9_passages(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    items = load(spark, sf_dir, "eval_items").select("item_id", "suite")
    return items.join(leaks, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored text lacks its end."""
    return truncation_scores(load(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, truncated documents and rate of each source."""
    scored = truncation_scores(load(spark, sf_dir, "documents"))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("truncated").cast("bigint")).alias("n_truncated"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"),
    )


QUERIES = {
    "p8_ids": p8_ids, "p9_found": p9_found, "p9_passages": p9_passages, "p9_leaked_items": p9_leaked_items,
    "p10_found": p10_found, "p10_rates": p10_rates,
}

SQL: dict[str, str] = {}
