"""Per-key results when a few keys hold most rows (tree aggregation, hot/cold lookups, pairs by cells)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import cut_lineage

#: Merge functions of the states a tree can carry.
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    rows: int,
    chunk_rows: int = 65_536,
    fan_in: int = 16,
) -> DataFrame:
    """One row per key of ``df`` without any task that receives all partials of a hot key.

    Input rows are cut into chunks of at most ``chunk_rows`` consecutive rows of a partition.
    Round 0 combines each chunk on its own (its rows lie in one partition, so they are combined before the
    exchange); every later round merges ``fan_in`` chunk states of a key, so ``ceil(log_fan_in(rows / chunk_rows))`` rounds leave one state per
    key and no reducer reads more than ``fan_in`` states of any key in a round.

    ``measures`` maps an output name to ``(merge, expression)`` with merge ``sum``, ``min`` or
    ``max``; a count is the sum of a literal one.  ``rows`` is an upper bound of the row count and
    only sets the number of rounds.  Null keys form a group of their own (as SQL GROUP BY), an
    empty table gives no rows, null measure values are ignored and give null if nothing else is there.
    """
    key_cols = list(keys)
    # names of the tree's own, so that columns of the input called "chunk" or like a measure can't clash
    state = {f"__state_{i}": (name, merge) for i, (name, (merge, _)) in enumerate(measures.items())}
    chunks = max(1, math.ceil(rows / chunk_rows))
    row = F.monotonically_increasing_id()
    partition, offset = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    level = df.select(
        *[F.col(f"`{k}`") for k in key_cols],
        *[e.alias(s) for s, (_, e) in zip(state, measures.values())],
        F.pmod(F.xxhash64(partition, F.floor(offset / chunk_rows)), F.lit(chunks)).alias("__chunk"),
    )
    while True:
        group = [F.col(f"`{k}`") for k in key_cols] + ([F.col("__chunk")] if chunks > 1 else [])
        level = level.groupBy(*group).agg(*[_MERGE[m](s).alias(s) for s, (_, m) in state.items()])
        if chunks == 1:
            return level.select(*[F.col(f"`{k}`") for k in key_cols], *[F.col(s).alias(n) for s, (n, _) in state.items()])
        chunks = math.ceil(chunks / fan_in)
        level = level.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in) if chunks > 1 else F.lit(0))


def heavy_keys(df: DataFrame, key: str, share: float = 0.03, rows: int | None = None) -> DataFrame:
    """Keys that stand in at least ``share`` of all rows of ``df``: ``(key_value, n_rows)``.

    The share counts every row, also repeated rows and rows with a null or empty key; null and ''
    are never reported.  At most ``1 / share`` keys come back, whatever the size.
    """
    rows = df.count() if rows is None else rows
    counts = tree_aggregate(df.select(F.col(f"`{key}`").alias("key_value")), ["key_value"], {"n_rows": ("sum", F.lit(1).cast("bigint"))}, rows)
    return counts.where(F.col("key_value").isNotNull() & (F.col("key_value") != "") & (F.col("n_rows") >= F.lit(share) * F.lit(rows)))


#: Keys with at least so many rows are hot whatever their share, so that no task of a join holds more rows of one key.
HOT_ROWS = 1_000_000


def hot_cold_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, rows: int, share: float = 0.001, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``keys``), where a few keys may hold most rows of ``left``.

    ``weight`` is the column of ``right`` with the number of ``left`` rows of the key, ``rows`` an upper
    bound of ``left``'s rows.  Keys with at least ``share`` of the rows, or ``HOT_ROWS`` of them, number at most
    ``1 / share + rows / HOT_ROWS`` by construction, so they are broadcast; all other keys meet in a shuffled
    join whose groups are below that.  Keys must not be null on ``right``; ``how`` is ``inner`` or ``left``.
    """
    keys = list(keys)
    limit = max(1, min(math.ceil(rows * share), HOT_ROWS))
    hot = right.where(F.col(weight) >= limit)
    cold = right.where(F.col(weight) < limit)
    marked = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    on_hot = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys, "inner")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, keys, how)
    return on_hot.unionByName(rest)


#: A lookup table of at most so many rows is broadcast whole.
LOOKUP_ROWS = 100_000


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, rows: int, how: str = "inner", most: int = LOOKUP_ROWS) -> DataFrame:
    """``hot_cold_join`` that first counts ``right``: up to ``most`` rows are broadcast whole, which leaves ``left`` where it is.

    ``right`` is counted, so it should be a table or a checkpoint.  The rows are the same either way.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), list(keys), how)
    return hot_cold_join(left, right, keys, weight, rows, how=how)


#: Rows of one key that a side brings into a cell of ``cell_join``; a cell gives about the square of it at most.
CELL_ROWS = 2048

#: Rows that a task of ``cell_join`` gives on average, a few full cells.
TASK_ROWS = 8_000_000


def cell_join(left: DataFrame, right: DataFrame, key: str, cell_rows: int = CELL_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Inner join on ``key``, of which both sides may hold many rows, so that the rows of a key are far more than those of the sides.

    The rows of a key are cut into chunks of about ``cell_rows`` on either side, and each pair of chunks meets in an exchange cell
    of its own.  A row is sent once for each chunk of the other side: a full cell sends ``2 * cell_rows`` rows and gives
    their square, no task holds all pairs of a hot key, and the pairs themselves are not shuffled.  Chunks go by the hash
    of the row, so equal rows share one.  Both sides are read twice and should be tables or checkpoints.  Keys that have more than one chunk on a side
    are broadcast, at most one a ``cell_rows`` rows of the sides by construction.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    both = cut_lineage(sizes(left, "__lefts").join(sizes(right, "__rights"), key))
    pairs = both.agg(F.sum(F.col("__lefts") * F.col("__rights"))).first()[0] or 0
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / task_rows))
    chunks = [F.ceil(F.col(c) / cell_rows).alias(f"{c}_n") for c in ("__lefts", "__rights")]
    hot = F.broadcast(both.where((F.col("__lefts") > cell_rows) | (F.col("__rights") > cell_rows)).select(key, *chunks))

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        marked = df.join(hot, key, "left").withColumn(own, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(f"{own}_n", F.lit(1))))
        dealt = marked.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"{other}_n", F.lit(1)) - 1)))
        return dealt.drop("__lefts_n", "__rights_n").repartition(n, key, "__lefts", "__rights")

    return side(left, "__lefts", "__rights").join(side(right, "__rights", "__lefts"), [key, "__lefts", "__rights"]).drop("__lefts", "__rights")


def running_totals(df: DataFrame, order: Sequence[Column], amount: Column, within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``__ahead``, the sum of ``amount`` over all rows before it in the total order, and ``__all``, the sum over all.

    Rows are range-partitioned by (``within``, ``order``) and written to the checkpoint folder once; the sums
    of the partitions (one row per partition and group) give each partition its offset, and a window inside the
    partition does the rest, so no task sorts the whole.  Sums start anew for each value of ``within``.
    With ``amount`` 1, ``__ahead`` is the 0-based position.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in within]
    ranged = cut_lineage(df.withColumn("__amount", amount).repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part", *within).agg(F.sum("__amount").alias("__sum"))
    # one row per partition and group: at most partitions * groups rows, of which the groups are the caller's few
    group = Window.partitionBy(*within)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *within, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"), F.sum("__sum").over(group).alias("__all"))
    inside = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    joined = local.join(F.broadcast(offsets), ["__part", *within])
    return joined.withColumn("__ahead", F.col("__offset") + F.col("__local")).drop("__part", "__amount", "__local", "__offset")
