"""Test quality: which production classes tests touch, how isolated tests are, and what no test touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.session import cut_lineage


def touched_classes(classes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``(scope, file_id, class_name)``: production classes that each test file depends on, once each.

    ``classes(scope, class_name, ...)`` is the index of production classes; ``dependencies(scope, file_id, is_test, class_name,
    namespace)`` names a class, or where it has no class name a namespace.
    """
    named = dependencies.where("is_test").select("scope", "file_id", F.coalesce(F.nullif("class_name", F.lit("")), "namespace").alias("class_name"))
    return named.distinct().join(classes.select("scope", "class_name").distinct(), ["scope", "class_name"], "left_semi").select("scope", "file_id", "class_name")


def chain_depth(touched: DataFrame, links: DataFrame, most: int = 4) -> DataFrame:
    """``(scope, file_id, depth)``: how far production dependencies lead on from what a test touches, at most ``most`` steps.

    ``links(scope, src, dst)`` are the distinct dependencies between production classes.  One anti join a step on a
    checkpointed frontier, as many steps as there are new classes.
    """
    seen = touched.select("scope", "file_id", F.col("class_name").alias("node"))
    frontier = seen
    depths = touched.select("scope", "file_id").distinct().withColumn("depth", F.lit(0))
    steps = [depths]
    for d in range(1, most + 1):
        step = frontier.join(links.select("scope", F.col("src").alias("node"), "dst"), ["scope", "node"]).select("scope", "file_id", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["scope", "file_id", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        steps.append(frontier.select("scope", "file_id").distinct().withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.groupBy("scope", "file_id").agg(F.max("depth").alias("depth"))


def test_files(tests: DataFrame, touched: DataFrame, depths: DataFrame) -> DataFrame:
    """``(scope, file_id, fan_out, depth, score, label)`` of every test file ``tests(scope, file_id)``; one that touches nothing is isolated."""
    fan = touched.groupBy("scope", "file_id").agg(F.count(F.lit(1)).alias("fan_out"))
    t = tests.distinct().join(fan, ["scope", "file_id"], "left").join(depths, ["scope", "file_id"], "left")
    t = t.select("scope", "file_id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("depth", F.lit(0)).alias("depth")).withColumn("score", M.isolation_score("fan_out", "depth"))
    return t.withColumn("label", M.isolation_label("score"))


def untested_classes(classes: DataFrame, touched: DataFrame) -> DataFrame:
    """Production classes that no test touches, with their orphan weight."""
    alone = classes.join(touched.select("scope", "class_name").distinct(), ["scope", "class_name"], "left_anti")
    return alone.withColumn("weight", M.orphan_weight(F.coalesce("ccn", F.lit(0)), F.coalesce("efferent", F.lit(0)), F.coalesce("afferent", F.lit(0))))


def totals(classes: DataFrame, touched: DataFrame, tests: DataFrame) -> DataFrame:
    """``(scope, n_classes, n_tested, traceability, n_test_files, isolation, label)`` of each scope; ``tests`` as ``test_files`` gives them."""
    tested = touched.select("scope", "class_name").distinct().withColumn("tested", F.lit(1))
    c = classes.select("scope", "class_name").distinct().join(tested, ["scope", "class_name"], "left").groupBy("scope").agg(F.count(F.lit(1)).alias("n_classes"), F.count("tested").alias("n_tested"))
    t = tests.groupBy("scope").agg(F.count(F.lit(1)).alias("n_test_files"), F.avg("score").alias("isolation"))
    j = c.join(t, "scope", "full_outer").select("scope", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_classes", "n_tested", "n_test_files")], F.round(F.coalesce("isolation", F.lit(0.0)), 6).alias("isolation"))
    share = F.when(F.col("n_classes") > 0, F.round(F.col("n_tested") * 100 / F.col("n_classes"), 6)).otherwise(0.0)
    return j.select("scope", "n_classes", "n_tested", share.alias("traceability"), "n_test_files", "isolation", M.isolation_label("isolation").alias("label"))
