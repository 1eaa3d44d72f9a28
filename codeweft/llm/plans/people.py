"""Queries over authors: p1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.names import link_authors, same_entity_pairs
from codeweft.session import cut_lineage, load


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author row with the smallest identity_id of its person or organisation."""
    links = cut_lineage(link_authors(load(spark, sf_dir, "authors"), load(spark, sf_dir, "commits").select("author", "email")))
    first = links.groupBy("entity").agg(F.min("identity_id").alias("entity_id"))
    return links.join(first, "entity").select("identity_id", "entity_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of author rows that belong to one person or organisation."""
    return same_entity_pairs(link_authors(load(spark, sf_dir, "authors"), load(spark, sf_dir, "commits").select("author", "email")))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}

SQL: dict[str, str] = {}
