"""Items that appear together: pair counts of baskets by basket collapsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import hot_cold_join
from codeweft.session import cut_lineage

#: Files of a block; a basket of more files is cut into blocks, whose pairs are dealt out over the tasks.
BLOCK = 128


def commit_items(log: DataFrame) -> DataFrame:
    """Distinct ``(repo, hash, file)`` of deliveries ``log(repo, hash, files)``.

    A commit is (repo, hash); deliveries of the same commit count once and a path counts once per
    commit.  Rows whose repo or hash is null name no commit and are left out, as are null paths.
    """
    return (
        log.select("repo", "hash", F.explode("files").alias("file"))
        .where(F.col("repo").isNotNull() & F.col("hash").isNotNull() & F.col("file").isNotNull())
        .distinct()
    )


def pair_counts(items: DataFrame, item_rows: int, min_support: int = 4, min_lift: float | None = 5.0, block: int = BLOCK) -> DataFrame:
    """``(repo, file_a, file_b, n_ab, n_a, n_b, n, lift, conviction)`` of pairs with enough support.

    1. n_a per file and n per repo.  A pair needs n_ab >= ``min_support`` and n_ab <= min(n_a, n_b),
       so files below the support can't take part; with ``min_lift`` L, n_ab * n >= L * n_a * n_b
       also needs n >= L * max(n_a, n_b).  Both cuts are exact: no qualifying pair is lost.  Files that are
       left get a number, which stands for their path until the pairs are known.
    2. Basket collapsing: equal sorted arrays of files of a repo become one basket with a weight.
    3. Pairs are enumerated once per distinct basket and the weights are summed.  Baskets of at most ``block``
       files are enumerated where they lie; wider ones are cut into pairs of blocks, which are dealt out by an
       exchange before they are enumerated, so that a commit over very many files is no straggler.

    A basket carries the counts of its files, so no pair is joined to them.  file_a < file_b by bytes.  An empty
    table gives no rows.
    """
    by_file = items.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n_file"))
    by_repo = items.groupBy("repo").agg(F.count_distinct("hash").alias("n"))
    frequent = by_file.where(F.col("n_file") >= min_support).join(by_repo, "repo")  # files of one repo: AQE splits a hot one
    if min_lift is not None:
        frequent = frequent.where(F.col("n") >= F.lit(min_lift) * F.col("n_file"))
    frequent = cut_lineage(frequent.withColumn("fid", F.monotonically_increasing_id()))  # numbers stay as written
    kept = hot_cold_join(items, frequent, ["repo", "file"], "n_file", item_rows)
    baskets = (
        kept.groupBy("repo", "hash").agg(F.array_sort(F.collect_list(F.struct("fid", F.col("n_file").alias("k")))).alias("basket"), F.first("n").alias("n"))
        .where(F.size("basket") > 1)
        .groupBy("repo", "basket").agg(F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"))
    )
    baskets = cut_lineage(baskets.select("basket", "weight", "n"))
    whole = baskets.where(F.size("basket") <= block).select("weight", "n", F.col("basket").alias("left"), F.col("basket").alias("right"))
    blocks = F.floor((F.size("basket") - 1) / block).cast("int")
    part = lambda i: F.slice("basket", i * block + 1, F.lit(block))
    wide = (
        baskets.where(F.size("basket") > block)
        .select("weight", "n", "basket", F.explode(F.sequence(F.lit(0), blocks)).alias("p"))
        .select("weight", "n", "basket", "p", F.explode(F.sequence(F.col("p"), blocks)).alias("q"))
        .select("weight", "n", part(F.col("p")).alias("left"), part(F.col("q")).alias("right"))
    )
    wide = wide.repartition(F.xxhash64("left", "right"))
    pairs = (
        whole.unionByName(wide)
        .select("weight", "n", "right", F.explode("left").alias("a"))
        .select("weight", "n", "a", F.explode(F.filter("right", lambda b: b["fid"] > F.col("a.fid"))).alias("b"))
        .groupBy(F.col("a.fid").alias("a"), F.col("b.fid").alias("b"))
        .agg(F.sum("weight").alias("n_ab"), F.first("a.k").alias("k_a"), F.first("b.k").alias("k_b"), F.first("n").alias("n"))
        .where(F.col("n_ab") >= min_support)
    )
    if min_lift is not None:
        pairs = pairs.where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("k_a") * F.col("k_b"))
    name = lambda end: frequent.select(F.col("fid").alias(end), F.col("file").alias(f"file_{end}"), *(["repo"] if end == "a" else []))
    named = pairs.join(name("a"), "a").join(name("b"), "b")
    turned = F.col("file_a") > F.col("file_b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    named = named.select("repo", pick("file_a", "file_b").alias("file_a"), pick("file_b", "file_a").alias("file_b"), "n_ab", pick("k_a", "k_b").alias("n_a"), pick("k_b", "k_a").alias("n_b"), "n")
    n_ab, n_a, n_b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    return named.select(
        "repo", "file_a", "file_b", "n_ab", "n_a", "n_b", "n",
        (n_ab * n / (n_a * n_b)).alias("lift"),
        # conviction of a -> b; null where every commit with a has b (no counterexample)
        F.when(n_ab < n_a, (F.lit(1.0) - n_b / n) / (F.lit(1.0) - n_ab / n_a)).alias("conviction"),
    )
