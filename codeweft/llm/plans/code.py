"""Queries over code, metrics and commits: p3, p4, p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.cooccurrence import commit_items, pair_counts
from codeweft.llm.ranking import median_rank
from codeweft.llm.splits import assign_splits, members_of_groups, sample_groups
from codeweft.session import cut_lineage, load


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measured items, worst first, by median rank over four scores."""
    return median_rank(load(spark, sf_dir, "metrics"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier records that must stay with another record, with their group."""
    return members_of_groups(sample_groups(load(spark, sf_dir, "class_samples")), "sample_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every classifier record with its group and split."""
    samples = load(spark, sf_dir, "class_samples")
    return assign_splits(samples, cut_lineage(sample_groups(samples)), "sample_id", F.col("label"))


def p4_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and share of each label in each split."""
    placed = p4_splits(spark, sf_dir).join(load(spark, sf_dir, "class_samples").select("sample_id", "label"), "sample_id")
    counts = placed.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n_split"))
    return counts.join(F.broadcast(whole), "split").withColumn("label_share", F.round(F.col("n") / F.col("n_split"), 6))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files of a repo with common commits, lift and conviction (support and lift as p7_found)."""
    items = cut_lineage(commit_items(load(spark, sf_dir, "commit_log")))
    return pair_counts(items, items.count())


def p7_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of files of a repo with a common commit, with counts, lift and conviction, whatever its support."""
    items = cut_lineage(commit_items(load(spark, sf_dir, "commit_log")))
    return pair_counts(items, items.count(), min_support=1, min_lift=None)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with at least 4 common commits and at least 5 times as many as chance."""
    return p7_pairs(spark, sf_dir).select("repo", "file_a", "file_b")


_P7 = """
    WITH items AS (SELECT DISTINCT repo, hash, f AS file FROM (SELECT repo, hash, unnest(files) AS f FROM commit_log)
                   WHERE f IS NOT NULL AND repo IS NOT NULL AND hash IS NOT NULL),
         n AS (SELECT repo, count(DISTINCT hash) AS n FROM items GROUP BY repo),
         c AS (SELECT repo, file, count(*) AS k FROM items GROUP BY repo, file),
         ab AS (SELECT x.repo, x.file AS file_a, y.file AS file_b, count(*) AS n_ab
                FROM items x JOIN items y ON x.repo = y.repo AND x.hash = y.hash AND x.file < y.file
                GROUP BY 1, 2, 3 HAVING count(*) >= 4),
         s AS (SELECT ab.repo, file_a, file_b, n_ab, a.k AS n_a, b.k AS n_b, n.n
               FROM ab JOIN c a ON a.repo = ab.repo AND a.file = file_a JOIN c b ON b.repo = ab.repo AND b.file = file_b
               JOIN n ON n.repo = ab.repo WHERE n_ab * n.n >= 5 * a.k * b.k)
"""

QUERIES = {"p3_ranking": p3_ranking, "p4_found": p4_found, "p4_splits": p4_splits, "p4_split_report": p4_split_report, "p7_found": p7_found, "p7_pairs": p7_pairs, "p7_all_pairs": p7_all_pairs}

SQL = {
    "p3_ranking": """
        WITH v AS (SELECT item_id, s, x FROM (
                SELECT item_id, 'risk' AS s, max(CASE WHEN isnan(risk_score) THEN NULL ELSE risk_score END) AS x FROM metrics GROUP BY item_id
                UNION ALL SELECT item_id, 'ccn', max(CAST(cyclomatic_complexity AS DOUBLE)) FROM metrics GROUP BY item_id
                UNION ALL SELECT item_id, 'mi', max(CASE WHEN isnan(maintainability_index) THEN NULL ELSE -maintainability_index END) FROM metrics GROUP BY item_id
                UNION ALL SELECT item_id, 'loc', max(CAST(loc AS DOUBLE)) FROM metrics GROUP BY item_id) WHERE x IS NOT NULL AND item_id IS NOT NULL),
             r AS (SELECT item_id, s, (rank() OVER (PARTITION BY s ORDER BY x DESC) - 1
                        + (count(*) OVER (PARTITION BY s, x) + 1) / 2.0) / count(*) OVER (PARTITION BY s) AS rk FROM v),
             l AS (SELECT item_id, count(*) AS n_scores, list_sort(list(CAST(rk AS DOUBLE))) AS rs FROM r GROUP BY item_id),
             i AS (SELECT item_id, n_scores, (rs[(n_scores + 1) // 2] + rs[n_scores // 2 + 1]) / 2 AS median_rank, list_sum(rs) / n_scores AS mean_rank FROM l),
             e AS (SELECT m.item_id, CAST(coalesce(n_scores, 0) AS INTEGER) AS n_scores, median_rank, mean_rank
                   FROM (SELECT DISTINCT item_id FROM metrics WHERE item_id IS NOT NULL) m LEFT JOIN i ON i.item_id = m.item_id)
        SELECT item_id, n_scores, round(median_rank, 9) AS median_rank, round(mean_rank, 9) AS mean_rank,
               row_number() OVER (ORDER BY median_rank ASC NULLS LAST, mean_rank ASC NULLS LAST, item_id ASC) AS position FROM e""",
    "p7_all_pairs": """
        WITH items AS (SELECT DISTINCT repo, hash, f AS file FROM (SELECT repo, hash, unnest(files) AS f FROM commit_log)
                       WHERE f IS NOT NULL AND repo IS NOT NULL AND hash IS NOT NULL),
             n AS (SELECT repo, count(DISTINCT hash) AS n FROM items GROUP BY repo),
             c AS (SELECT repo, file, count(*) AS k FROM items GROUP BY repo, file),
             ab AS (SELECT x.repo, x.file AS file_a, y.file AS file_b, count(*) AS n_ab
                    FROM items x JOIN items y ON x.repo = y.repo AND x.hash = y.hash AND x.file < y.file GROUP BY 1, 2, 3)
        SELECT ab.repo, file_a, file_b, n_ab, a.k AS n_a, b.k AS n_b, n.n, CAST(n_ab AS DOUBLE) * n.n / (CAST(a.k AS DOUBLE) * b.k) AS lift,
               CASE WHEN n_ab < a.k THEN (1.0 - CAST(b.k AS DOUBLE) / n.n) / (1.0 - CAST(n_ab AS DOUBLE) / a.k) END AS conviction
        FROM ab JOIN c a ON a.repo = ab.repo AND a.file = file_a JOIN c b ON b.repo = ab.repo AND b.file = file_b JOIN n ON n.repo = ab.repo""",
    "p7_found": _P7 + "SELECT repo, file_a, file_b FROM s",
    "p7_pairs": _P7 + """
        SELECT repo, file_a, file_b, n_ab, n_a, n_b, n, CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b) AS lift,
               CASE WHEN n_ab < n_a THEN (1.0 - CAST(n_b AS DOUBLE) / n) / (1.0 - CAST(n_ab AS DOUBLE) / n_a) END AS conviction FROM s""",
    "p4_found": """
        WITH RECURSIVE a AS (SELECT sample_id AS id, regexp_replace(regexp_replace(regexp_replace(trim(file_path), '\\\\', '/', 'g'), '/+', '/', 'g'), '^/builds/', '') AS p,
                  regexp_replace(regexp_replace(regexp_replace(trim(class_name), '\\\\|::|/', '.', 'g'), '\\.+', '.', 'g'), '^\\.|\\.$', '', 'g') AS c, lower(trim(programming_language)) AS l FROM class_samples WHERE sample_id IS NOT NULL),
             b AS (SELECT id, nullif(regexp_replace(regexp_replace(p, '(^|/)(?:\\./)+', '\\1', 'g'), '^/', ''), '') AS p, c,
                  CASE l WHEN 'golang' THEN 'go' WHEN 'typescript' THEN 'ts' WHEN 'javascript' THEN 'js' WHEN 'csharp' THEN 'c#' WHEN 'cs' THEN 'c#' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' ELSE l END AS l FROM a),
             k AS (SELECT id, 'f|' || p AS e FROM b WHERE p IS NOT NULL UNION SELECT id, 'c|' || l || '|' || c FROM b WHERE contains(c, '.') AND l <> ''),
             g AS (SELECT DISTINCT x.id, y.id AS other FROM k x JOIN k y ON y.e = x.e),
             r AS (SELECT id, other FROM g UNION SELECT r.id, g.other FROM r JOIN g ON g.id = r.other)
        SELECT id AS sample_id, min(other) AS group_id FROM r GROUP BY id HAVING count(*) > 1""",
}
