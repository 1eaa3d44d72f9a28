"""Structured Streaming: tumbling activity windows, late data, watch mode."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_activity(stream: DataFrame, at: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, key, n, total)`` per tumbling window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def watch(spark: SparkSession, folder: str, recompute: Callable[[DataFrame], None], checkpoint: str):
    """Start watch mode: each batch of new files under ``folder`` triggers ``recompute`` on all of them.

    Editors' swap and backup files are left out.  ``checkpoint`` must be a folder that all executors share.
    """
    stream = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    named = stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source_text")).where(~F.col("path").rlike(r"\.swp$|~$"))
    return named.writeStream.foreachBatch(lambda df, _: recompute(df)).option("checkpointLocation", checkpoint).start()


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a bounded stream to its end through a memory table (tests and demonstrations)."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if shared:  # the cluster's shared folder; Spark's own temporary one only in a local session
        # a place of its own for each run: one that is used again would go on where another run stopped
        writer = writer.option("checkpointLocation", f"{shared.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}")
    writer.start().awaitTermination()
    return df.sparkSession.table(name)
