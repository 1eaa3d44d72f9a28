"""Git activity: commits per file, bus factor, top committers, months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.skew import running_totals

#: Authors that stand for no person.
NO_AUTHORS = ("", "noreply@github.com")


def author_touches(commits: DataFrame, by: Sequence[str] = (), excluded: Sequence[str] = NO_AUTHORS) -> DataFrame:
    """Touched files per author (and ``by``), without nameless authors; repeated rows count as delivered."""
    named = commits.where(F.col("author").isNotNull() & ~F.col("author").isin(list(excluded)))
    return named.groupBy(*by, "author").agg(F.count(F.lit(1)).alias("touches"))


def _ranked(touches: DataFrame, by: Sequence[str]) -> DataFrame:
    """``touches`` with ``total``, ``upto`` (running sum by touches, then name) and ``rank``.

    Within a scope by windows over its authors; over all authors by range partitions, so that no task sorts the whole.
    """
    order = [F.col("touches").desc(), F.col("author")]
    if not by:
        summed = running_totals(touches, order, F.col("touches")).withColumn("upto", F.col("__ahead") + F.col("touches")).withColumnRenamed("__all", "total").drop("__ahead")
        return running_totals(summed, order, F.lit(1).cast("bigint")).withColumn("rank", (F.col("__ahead") + 1).cast("int")).drop("__ahead", "__all")
    part = Window.partitionBy(*by)
    running = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return touches.withColumn("total", F.sum("touches").over(part)).withColumn("upto", F.sum("touches").over(running)).withColumn("rank", F.row_number().over(part.orderBy(*order)))


def bus_factor(touches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., bus_factor, total)``: the fewest authors that made half (rounded down) of the touches.

    Authors are taken by touches, then name.  The running sum sees one row per author, after aggregation.
    """
    enough = _ranked(touches, by).where(F.col("upto") >= F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min("rank").alias("bus_factor"), F.max("total").alias("total"))
    return enough if by else enough.where(F.col("total").isNotNull())


def top_committers(touches: DataFrame, by: Sequence[str] = (), n: int = 4) -> DataFrame:
    """The ``n`` authors with most touches, with their share in percent."""
    return _ranked(touches, by).where(F.col("rank") <= n).select(*by, "rank", "author", "touches", F.round(F.col("touches") * 100 / F.col("total"), 6).alias("percentage"))


def commits_per_month(commits: DataFrame, year: int) -> DataFrame:
    """Twelve rows (Jan to Dec) of one year with distinct commits, 0 where there are none."""
    spark = commits.sparkSession
    at = F.timestamp_seconds(F.col("ts"))
    sane = commits.where((F.col("ts") > 0) & (F.col("ts") < 4102444800) & (F.year(at) == year))
    counts = sane.groupBy(F.month(at).alias("month")).agg(F.count_distinct("repo", "hash").alias("n"))
    spine = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    label = F.date_format(F.make_date(F.lit(year), F.col("month"), F.lit(1)), "MMM")
    return spine.join(counts, "month", "left").select("month", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n_commits"))
