"""Queries of the operator for keys that hold most rows (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.skew import heavy_keys, tree_aggregate
from codeweft.session import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of commits.author and edges.src that stand in at least 3 % of their table's rows."""
    found = [
        heavy_keys(load(spark, sf_dir, table).select(column), column).select(F.lit(f"{table}.{column}").alias("field_name"), "key_value")
        for table, column in (("commits", "author"), ("edges", "src"))
    ]
    return found[0].unionByName(found[1])


def p2_author_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author of commits (null and '' included as they stand): touched rows and distinct files."""
    commits = load(spark, sf_dir, "commits").select("author", "file_id")
    rows = commits.count()
    one = F.lit(1).cast("bigint")
    touches = tree_aggregate(commits, ["author", "file_id"], {"n_rows": ("sum", one)}, rows)
    return tree_aggregate(
        touches, ["author"],
        {"n_rows": ("sum", F.col("n_rows")), "n_files": ("sum", F.col("file_id").isNotNull().cast("bigint"))},
        rows,
    )


def p2_package_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source package of edges: entries, distinct targets and total weight (null weights add nothing)."""
    edges = load(spark, sf_dir, "edges").select("src", "dst", "weight")
    rows = edges.count()
    by_pair = tree_aggregate(edges, ["src", "dst"], {"n_rows": ("sum", F.lit(1).cast("bigint")), "weight": ("sum", F.col("weight"))}, rows)
    return tree_aggregate(
        by_pair, ["src"],
        {
            "n_rows": ("sum", F.col("n_rows")),
            "n_targets": ("sum", F.col("dst").isNotNull().cast("bigint")),
            "total_weight": ("sum", F.coalesce(F.col("weight"), F.lit(0).cast("bigint"))),
        },
        rows,
    )


QUERIES = {"p2_found": p2_found, "p2_author_totals": p2_author_totals, "p2_package_totals": p2_package_totals}

SQL = {
    "p2_found": """
        SELECT 'commits.author' AS field_name, author AS key_value FROM commits
        WHERE author IS NOT NULL AND author <> '' GROUP BY author
        HAVING count(*) >= 0.03 * (SELECT count(*) FROM commits)
        UNION ALL
        SELECT 'edges.src', src FROM edges WHERE src IS NOT NULL AND src <> '' GROUP BY src
        HAVING count(*) >= 0.03 * (SELECT count(*) FROM edges)""",
    "p2_author_totals": "SELECT author, count(*) AS n_rows, count(DISTINCT file_id) AS n_files FROM commits GROUP BY author",
    "p2_package_totals": """
        SELECT src, count(*) AS n_rows, count(DISTINCT dst) AS n_targets,
               CAST(coalesce(sum(weight), 0) AS BIGINT) AS total_weight
        FROM edges GROUP BY src""",
}
