"""Comparison of two revisions: deltas, findings, lint differences, quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Version of the method of comparison, which reports state.
METHODOLOGY = "1.0"
#: Thresholds of the review, by name.
DEFAULTS = {"ccn": 10, "ccn_high": 25, "ccn_jump": 10, "ccn_drop": 3, "mi": 85, "mi_high": 65, "mi_change": 5, "coupling": 3}


def file_changes(head: DataFrame, base: DataFrame, key: str = "path") -> DataFrame:
    """``(key, status, head_*, base_*)`` by full outer join; equal checksums are left out."""
    h = head.select(key, *[F.col(c).alias(f"head_{c}") for c in head.columns if c != key])
    b = base.select(key, *[F.col(c).alias(f"base_{c}") for c in base.columns if c != key])
    j = h.join(b, key, "full_outer")
    status = F.when(F.col("base_checksum").isNull(), "added").when(F.col("head_checksum").isNull(), "deleted").when(F.col("head_checksum") != F.col("base_checksum"), "changed")
    return j.withColumn("status", status).where(F.col("status").isNotNull())


def function_findings(head: DataFrame, base: DataFrame, opts: dict | None = None) -> DataFrame:
    """``(kind, severity, subject, before, after)`` of functions ``(subject, ccn)`` of both revisions."""
    o = {**DEFAULTS, **(opts or {})}
    j = head.select("subject", F.col("ccn").alias("after")).join(base.select("subject", F.col("ccn").alias("before")), "subject", "left")
    new, rise, drop = F.col("before").isNull() & (F.col("after") >= o["ccn"]), (F.col("after") > F.col("before")) & (F.col("after") >= o["ccn"]), F.col("before") - F.col("after") >= o["ccn_drop"]
    high = (F.col("after") >= o["ccn_high"]) | (F.col("after") - F.coalesce("before", "after") >= o["ccn_jump"])
    kind = F.when(new, "new-complex-function").when(rise, "complexity-regression").when(drop, "complexity-improvement")
    severity = F.when(new, F.when(F.col("after") >= o["ccn_high"], "high").otherwise("medium")).when(rise, F.when(high, "high").otherwise("medium")).when(drop, "low")
    return j.select(kind.alias("kind"), severity.alias("severity"), "subject", "before", "after").where("kind is not null")


def index_findings(head: DataFrame, base: DataFrame, opts: dict | None = None) -> DataFrame:
    """Maintainability and coupling findings of subjects ``(subject, mi, efferent)`` in both revisions."""
    o = {**DEFAULTS, **(opts or {})}
    j = head.select("subject", F.col("mi").alias("mi1"), F.col("efferent").alias("ce1")).join(base.select("subject", F.col("mi").alias("mi0"), F.col("efferent").alias("ce0")), "subject")
    worse = (F.col("mi0") - F.col("mi1") >= o["mi_change"]) & (F.col("mi1") < o["mi"])
    better = (F.col("mi1") - F.col("mi0") >= o["mi_change"]) & (F.col("mi0") < o["mi"])
    s = lambda cond, kind, sev, a, b: F.when(cond, F.struct(F.lit(kind).alias("kind"), sev.alias("severity"), F.round(F.col(a).cast("double"), 6).alias("before"), F.round(F.col(b).cast("double"), 6).alias("after")))
    found = F.array_compact(F.array(
        s(worse, "maintainability-regression", F.when(F.col("mi1") < o["mi_high"], "high").otherwise("medium"), "mi0", "mi1"), s(better, "maintainability-improvement", F.lit("low"), "mi0", "mi1"),
        s(F.col("ce1") - F.col("ce0") >= o["coupling"], "coupling-regression", F.lit("medium"), "ce0", "ce1"),
    ))
    return j.select("subject", F.explode(found).alias("f")).select("subject", "f.*")


def lint_diff(head: DataFrame, base: DataFrame, key) -> DataFrame:
    """Violations of ``head`` whose ``(rule, file, key)`` the base lacks."""
    h, b = head.withColumn("k", key), base.withColumn("k", key).select("rule", "file", "k").distinct()
    return h.join(b, ["rule", "file", "k"], "left_anti").drop("k")


def gate(findings: DataFrame, level: str) -> DataFrame:
    """One row ``(failed, n)``: regressions at or above ``level`` (high, medium, any, never)."""
    ranks = {"high": ["high"], "medium": ["high", "medium"], "any": ["high", "medium", "low"], "never": []}[level]
    bad = F.col("severity").isin(ranks) & ~F.col("kind").endswith("improvement") if ranks else F.lit(False)
    n = F.count_if(bad)
    return findings.agg((n > 0).alias("failed"), n.alias("n"))


def suggestions(files: DataFrame, hard: DataFrame, risk: float, commits: int, complexity: int, enough: int) -> DataFrame:
    """``(file_id, kind, location)``: hotspots, hard classes and complex busy files, each location once, files in order of their id
    until ``enough`` suggestions are found (those of the last file are kept whole).

    ``files(file_id, n, risk, ccn)`` with their commits, ``hard(file_id, location)`` classes below the index.  The first
    ``enough`` files with suggestions hold all that can be kept, so the order is a top-k and no sort of the whole.
    """
    busy = F.col("n") >= commits
    hot = files.where((F.col("risk") >= risk) & busy).select("file_id", F.lit("hotspot").alias("kind"), F.col("file_id").alias("location"))
    big = files.where((F.col("ccn") > complexity) & busy).select("file_id", F.lit("complex and busy").alias("kind"), F.col("file_id").alias("location"))
    found = hot.unionByName(hard.select("file_id", F.lit("low maintainability").alias("kind"), "location")).unionByName(big)
    once = found.groupBy("kind", "location").agg(F.min("file_id").alias("file_id"))
    first = once.groupBy("file_id").agg(F.count(F.lit(1)).alias("k")).orderBy("file_id").limit(enough)
    ahead = F.sum("k").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1))  # at most ``enough`` rows
    kept = first.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < enough)
    return once.join(F.broadcast(kept.select("file_id")), "file_id").select("file_id", "kind", "location")


def measure_deltas(head: DataFrame, base: DataFrame, measures: list[str], key: str = "scope") -> DataFrame:
    """``(key, delta_<measure>...)``: current minus compared of every measure of two aggregates; a scope that one lacks counts as 0 there."""
    h = head.select(key, *[F.col(m).alias(f"h_{m}") for m in measures])
    b = base.select(key, *[F.col(m).alias(f"b_{m}") for m in measures])
    j = h.join(b, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return j.select(key, *[F.round(zero(f"h_{m}") - zero(f"b_{m}"), 6).alias(f"delta_{m}") for m in measures])


def negligible(changes: DataFrame, measures: list[str]) -> DataFrame:
    """``changes`` with ``negligible``: a changed file none of whose measures moved."""
    same = F.lit(True)
    for m in measures:
        same = same & (F.coalesce(F.col(f"head_{m}").cast("double"), F.lit(0.0)) == F.coalesce(F.col(f"base_{m}").cast("double"), F.lit(0.0)))
    return changes.withColumn("negligible", (F.col("status") == "changed") & same)
