"""Queries over source files: p5 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.handwritten import judge_files
from codeweft.llm.syntax import broken_files
from codeweft.session import load


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text is not valid in the language of their extension."""
    return broken_files(load(spark, sf_dir, "files")).select("file_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, broken files and rate per repo and language; null and empty texts count as files."""
    files = load(spark, sf_dir, "files")
    broken = broken_files(files).select("file_id", F.lit(1).alias("broken"))
    joined = files.select("file_id", "repo", "programming_language").join(broken, "file_id", "left")
    return joined.groupBy("repo", "programming_language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("broken").alias("n_broken"), F.round(F.count("broken") / F.count(F.lit(1)), 6).alias("rate")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written for their own repo."""
    return judge_files(load(spark, sf_dir, "files")).where(F.col("reason").isNotNull()).select("file_id")


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repo, language and reason ('hand-written' where there is none)."""
    judged = judge_files(load(spark, sf_dir, "files"))
    return judged.groupBy("repo", "programming_language", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_reasons": p6_reasons}

SQL: dict[str, str] = {}
