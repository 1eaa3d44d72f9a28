"""Project roll-ups: sums, extremes, means and histograms by any grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(df: DataFrame, measures: Sequence[str], scopes: Sequence[str]) -> DataFrame:
    """One row per scope value and one for all (every scope column null), by grouping sets in one pass.

    A null or NaN measure counts in neither sum nor count.  A minimum ignores zeros, which stand for unset.
    """
    clean = df
    for m in measures:
        if dict(df.dtypes)[m] in ("double", "float"):
            clean = clean.withColumn(m, F.when(~F.isnan(m), F.col(m)))
    sets = [[]] + [[F.col(s)] for s in scopes]
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        c = F.col(m)
        aggs += [F.sum(c).alias(f"{m}_sum"), F.min(F.when(c != 0, c)).alias(f"{m}_min"), F.max(c).alias(f"{m}_max"), F.avg(c).alias(f"{m}_avg"), F.count(c).alias(f"{m}_count")]
    flags = [F.grouping(s).alias(f"all_{s}") for s in scopes]
    return clean.groupingSets(sets, *scopes).agg(*flags, *aggs)


def histogram(df: DataFrame, value: Column, edges: Sequence[tuple[str, float | None]]) -> DataFrame:
    """``(bucket, n)``: values below each edge in turn, the rest in the last; nulls in none, empty buckets with 0."""
    bucket = None
    for name, edge in edges:
        cond = F.lit(True) if edge is None else value < edge
        bucket = F.when(cond, name) if bucket is None else bucket.when(cond, name)
    counts = df.where(value.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(n,) for n, _ in edges], "bucket string")
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


#: Means of a project, each over what it is taken of: functions (f), classes (c), or both together (b).
MEANS = {
    "loc": ("b", "loc"), "lloc": ("b", "lloc"), "cloc": ("b", "cloc"), "methods_per_class": ("c", "n_methods"), "loc_per_class": ("c", "loc"), "loc_per_method": ("f", "loc"), "lloc_per_method": ("f", "lloc"), "cloc_per_method": ("f", "cloc"),
    "ccn": ("b", "ccn"), "ccn_per_method": ("f", "ccn"), "ccn_per_class": ("c", "ccn"), "h_difficulty": ("b", "h_difficulty"), "h_effort": ("b", "h_effort"), "h_volume": ("b", "h_volume"), "h_time": ("b", "h_time"), "h_bugs": ("b", "h_bugs"),
    "mi": ("b", "mi"), "mi_woc": ("b", "mi_woc"), "comment_weight": ("b", "comment_weight"), "mi_per_method": ("f", "mi"), "mi_woc_per_method": ("f", "mi_woc"), "comment_weight_per_method": ("f", "comment_weight"),
    "afferent": ("c", "afferent"), "efferent": ("c", "efferent"), "instability": ("c", "instability"),
}
#: Sums, extremes and counts of a project beside its means.
SUMS = ("h_difficulty", "h_effort", "h_volume", "h_time", "h_bugs")


def project_measures(functions: DataFrame, classes: DataFrame, scope: str = "scope") -> DataFrame:
    """One row a scope with the means ``avg_*`` of MEANS, the sums ``sum_*`` of SUMS, least and greatest complexity per function, and counts.

    Both tables have ``scope, loc, lloc, cloc, ccn, h_*, mi, mi_woc, comment_weight``, classes also ``n_methods, afferent,
    efferent, instability``.  They are put below each other and aggregated in one pass; a null or NaN counts in no mean, and 0 is
    no least complexity.
    """
    own = ["loc", "lloc", "cloc", "ccn", "h_difficulty", "h_effort", "h_volume", "h_time", "h_bugs", "mi", "mi_woc", "comment_weight"]
    only = ["n_methods", "afferent", "efferent", "instability"]
    f = functions.select(scope, F.lit("f").alias("kind"), *[F.col(c).cast("double").alias(c) for c in own], *[F.lit(None).cast("double").alias(c) for c in only])
    c = classes.select(scope, F.lit("c").alias("kind"), *[F.col(c).cast("double").alias(c) for c in own + only])
    both = f.unionByName(c)
    is_f, is_c = F.col("kind") == "f", F.col("kind") == "c"
    of = {"f": is_f, "c": is_c, "b": F.lit(True)}
    clean = lambda x: F.when(~F.isnan(x), F.col(x))
    aggs = [F.avg(F.when(of[k], clean(x))).alias(f"avg_{m}") for m, (k, x) in MEANS.items()]
    aggs += [F.sum(clean(x)).alias(f"sum_{x}") for x in SUMS]
    aggs += [F.min(F.when(is_f & (F.col("ccn") != 0), F.col("ccn"))).alias("min_ccn"), F.max(F.when(is_f, F.col("ccn"))).alias("max_ccn"), F.count_if(is_f).alias("n_methods"), F.count_if(is_c).alias("n_classes"), F.count_if(is_c & (F.col("loc") > 0)).alias("n_classes_with_code")]
    return both.groupBy(scope).agg(*aggs)
