"""One ranking from several differently scaled scores: median rank aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import hot_cold_join, running_totals
from codeweft.session import cut_lineage

#: Scores of the metrics table: direction 1 = higher is worse, -1 = lower is worse; and weight.
METRIC_SCORES = {"risk_score": (1, 1.0), "cyclomatic_complexity": (1, 1.0), "maintainability_index": (-1, 1.0), "loc": (1, 1.0)}


def score_entries(items: DataFrame, key: str, scores: dict[str, tuple[int, float]]) -> DataFrame:
    """``(key, score, value, weight)``, one row per present score, and one with null score for an item without any.

    An item given more than once keeps its worst value of each score; NaN is missing; 0.0 and -0.0 are one value.
    """
    worst = items.where(F.col(key).isNotNull()).select(
        key, *[(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) * F.lit(float(d)) + F.lit(0.0)).alias(c) for c, (d, _) in scores.items()]
    ).groupBy(key).agg(*[F.max(c).alias(c) for c in scores])
    entries = F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("value"), F.lit(float(w)).alias("weight")) for c, (_, w) in scores.items()])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return worst.select(key, F.explode_outer(present).alias("e")).select(key, "e.*")


def score_ranks(entries: DataFrame, key: str) -> DataFrame:
    """``(key, rank, weight)`` of ``score_entries``: the share of a score's values that are worse, ties at their middle.

    Ranks lie in (0, 1], so that a score with more missing values weighs no less; an entry without a score has a
    null rank.  The ranks are made on distinct values with counts: a value that a third of the items share is one
    row there, and is looked up by broadcast as are all values of at least 0.1 %.
    """
    entries = cut_lineage(entries)
    known = entries.where(F.col("score").isNotNull())
    values = known.groupBy("score", "value").agg(F.count(F.lit(1)).alias("n_equal"))
    placed = running_totals(values, [F.col("value").desc()], F.col("n_equal"), within=["score"])
    rank = (F.col("__ahead") + (F.col("n_equal") + F.lit(1)) / F.lit(2.0)) / F.col("__all")
    ranks = placed.select("score", "value", "n_equal", rank.alias("rank"))
    ranked = hot_cold_join(known, ranks, ["score", "value"], "n_equal", entries.count()).select(key, "rank", "weight")
    return ranked.unionByName(entries.where(F.col("score").isNull()).select(key, F.lit(None).cast("double").alias("rank"), "weight"))


def median_rank(items: DataFrame, key: str = "item_id", scores: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """``(key, n_scores, median_rank, mean_rank, position)``, worst item first at position 1.

    Order: weighted median of the item's ranks (the lower and upper middle averaged where the
    weight splits evenly), then weighted mean rank, then key.  The order uses the ranks as they are; only the
    output is rounded.  Items of which every score is missing come last, with null ranks.  Rows without a key are
    no items; an empty table gives no rows.
    """
    ranked = score_ranks(score_entries(items, key, scores or METRIC_SCORES), key)
    entry = F.when(F.col("rank").isNotNull(), F.struct("rank", "weight"))
    per_item = ranked.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("r"))  # as many entries as scores
    half = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["weight"]) / 2
    # running weight before each entry; the lower middle reaches half, the upper one passes it
    running = F.transform("r", lambda x, i: F.struct(x["rank"].alias("rank"), F.aggregate(F.slice("r", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["weight"]).alias("upto")))
    per_item = per_item.withColumn("half", half).withColumn("run", running)
    low = F.get(F.filter("run", lambda x: x["upto"] >= F.col("half")), F.lit(0))["rank"]
    high = F.get(F.filter("run", lambda x: x["upto"] > F.col("half")), F.lit(0))["rank"]
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["rank"] * x["weight"]) / F.when(F.col("half") > 0, F.col("half") * 2)
    per_item = per_item.select(key, F.size("r").alias("n_scores"), ((low + high) / 2).alias("median_rank"), mean.alias("mean_rank"))
    order = [F.col("median_rank").asc_nulls_last(), F.col("mean_rank").asc_nulls_last(), F.col(key).asc()]
    placed = running_totals(per_item, order, F.lit(1).cast("bigint"))
    return placed.select(key, "n_scores", F.round("median_rank", 9).alias("median_rank"), F.round("mean_rank", 9).alias("mean_rank"), (F.col("__ahead") + 1).alias("position"))
