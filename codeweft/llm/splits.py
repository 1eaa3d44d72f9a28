"""Splits that keep related records together: label propagation, then stratified group assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.skew import hot_cold_join
from codeweft.session import cut_lineage

#: Spellings of languages that mean another name (fixed values).
LANGUAGE_ALIASES = {"golang": "go", "typescript": "ts", "javascript": "js", "csharp": "c#", "cs": "c#", "py": "python", "rs": "rust"}

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def path_key(path: Column, prefixes: tuple[str, ...] = ("/builds/",)) -> Column:
    """A file path however written: trimmed, forward slashes, no ``./``, no doubled slashes, no checkout prefix."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, "/+", "/")
    for prefix in prefixes:
        p = F.regexp_replace(p, "^" + prefix, "")
    p = F.regexp_replace(p, r"(^|(?<=/))(\./)+", "")
    p = F.regexp_replace(p, "^/", "")
    return F.when(p != "", p)


def class_key(name: Column, language: Column) -> Column:
    """A class with namespace in a language however written; null for bare names and without a language, which connect nothing."""
    c = F.regexp_replace(F.regexp_replace(F.trim(name), r"\\|::|/", "."), r"\.+", ".")
    c = F.regexp_replace(c, r"^\.|\.$", "")
    lang = F.lower(F.trim(language))
    alias = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    lang = F.coalesce(F.try_element_at(alias, lang), lang)
    return F.when(c.contains(".") & lang.isNotNull() & (lang != ""), F.concat_ws("|", lang, c))


def related_groups(records: DataFrame, key: str, left: Column, right: Column, max_rounds: int = 60) -> DataFrame:
    """``(key, group_id, last_id)``: records joined by equal ``left`` or equal ``right`` entity, also through others.

    ``group_id`` and ``last_id`` are the smallest and the largest key of the group, which differ where it has two
    members.  Iterative minimum-label propagation over the bipartite graph of left and right entities, whose edges are
    the distinct (left, right) pairs of records:

    1. A left entity is labelled by its smallest key.  A right entity with one left entity joins nothing and follows it.
    2. In each round every remaining right entity takes the minimum label of its left entities, every left entity the
       minimum of its right ones, and labels are followed to their roots by pointer jumping.  Left entities of one
       root become one, repeated edges fall together and right entities with one edge drop out, so only what can
       still change goes on, at most half as many labels as before.

    Minima are combined before the shuffle, and keys with many rows are looked up by broadcast (``hot_cold_join``), so a
    hot entity is no straggler.  Rounds are checkpointed.  A null entity connects nothing, a record without entities
    is its own group; rows with a null key are left out; a key given twice with different entities is two records.
    """
    recs = cut_lineage(records.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), left.alias("l"), right.alias("r")))
    rows = recs.count()
    ends = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")]
    lefts = cut_lineage(recs.where(F.col("l").isNotNull()).groupBy("l").agg(*ends))
    alone = F.col("l").isNull()
    # a right entity by all its records, and by those that have no left entity and follow it
    own = [F.min(F.when(alone, F.col("id"))).alias("own_lo"), F.max(F.when(alone, F.col("id"))).alias("own_hi"), F.count_if(alone).alias("n_own")]
    edges = recs.where(F.col("l").isNotNull() & F.col("r").isNotNull()).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n_edge"))
    edges = cut_lineage(hot_cold_join(edges.select("l", "r"), lefts.select("l", F.col("lo").alias("a"), "n"), ["l"], "n", rows).select("a", "r"))
    by_right = edges.groupBy("r").agg(F.min("a").alias("first"), F.count(F.lit(1)).alias("n_left"))
    rights = recs.where(F.col("r").isNotNull()).groupBy("r").agg(F.min("id").alias("b"), *own)
    rights = cut_lineage(rights.join(by_right, "r", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0))))
    shared = rights.where(F.col("n_left") > 1).select("r", "b", "n_left")
    core = cut_lineage(hot_cold_join(edges, shared, ["r"], "n_left", rows).select("a", "b"))
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        n_core = core.count()
        if not n_core:
            break
        least = core.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        parents = hot_cold_join(core, least, ["b"], "n", n_core).groupBy("a").agg(F.min("m").alias("root"), F.count(F.lit(1)).alias("n_edges"))
        step = _roots(cut_lineage(parents), max_rounds)
        steps.append(step)
        merged = hot_cold_join(core, step, ["a"], "n_edges", n_core).select(F.col("root").alias("a"), "b").distinct()
        merged = cut_lineage(merged)
        still = merged.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        core = cut_lineage(hot_cold_join(merged, still, ["b"], "n", n_core).select("a", "b"))
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    # the root of every label that ever had one to follow, later rounds applied to earlier ones
    roots = None
    for step in reversed(steps):
        step = step.select("a", "root")
        if roots is None:
            roots = step
        else:
            later = roots.select(F.col("a").alias("root"), F.col("root").alias("further"))
            roots = cut_lineage(step.join(later, "root", "left").select("a", F.coalesce("further", "root").alias("root")).unionByName(roots.join(step.select("a"), "a", "left_anti")))
    def rooted(df: DataFrame, label: str) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col(label))
        return df.join(roots.withColumnRenamed("a", label), label, "left").withColumn("root", F.coalesce("root", F.col(label)))

    left_roots = rooted(lefts.withColumnRenamed("lo", "label").withColumn("lo", F.col("label")), "label").select("l", "root", "lo", "hi", "n")
    right_roots = rooted(rights.withColumn("label", F.coalesce("first", "b")), "label").select("r", "root", "own_lo", "own_hi", "n_own")
    members = cut_lineage(left_roots.select(F.lit("l").alias("side"), F.col("l").alias("entity"), "root", "lo", "hi", "n").unionByName(
        right_roots.select(F.lit("r").alias("side"), F.col("r").alias("entity"), "root", F.col("own_lo").alias("lo"), F.col("own_hi").alias("hi"), F.col("n_own").alias("n"))))
    groups = members.groupBy("root").agg(F.min("lo").alias("group_id"), F.max("hi").alias("last_id"), F.count(F.lit(1)).alias("n_entities"))
    placed = cut_lineage(hot_cold_join(members.where("n > 0"), groups, ["root"], "n_entities", rows).select("side", "entity", "group_id", "last_id", "n"))
    asked = recs.select("id", F.when(F.col("l").isNotNull(), "l").otherwise("r").alias("side"), F.coalesce("l", "r").alias("entity"))
    found = hot_cold_join(asked.where(F.col("entity").isNotNull()), placed, ["side", "entity"], "n", rows).select(F.col("id").alias(key), "group_id", "last_id")
    single = asked.where(F.col("entity").isNull()).select(F.col("id").alias(key), F.col("id").alias("group_id"), F.col("id").alias("last_id"))
    return found.unionByName(single)


def _roots(tree: DataFrame, max_rounds: int) -> DataFrame:
    """``tree(a, root, ...)``, in which ``root`` <= ``a`` is a parent, with parents followed to where they end."""
    for _ in range(max_rounds):  # each jump doubles the length of the chains that are followed
        users = tree.where("root < a").groupBy("root").agg(F.count(F.lit(1)).alias("n_users"))
        further = tree.where("root < a").select(F.col("a").alias("root"), F.col("root").alias("next")).join(users, "root")
        if further.isEmpty():
            return tree
        tree = cut_lineage(hot_cold_join(tree, further, ["root"], "n_users", tree.count(), how="left").withColumn("root", F.coalesce("next", "root")).drop("next", "n_users"))
    raise RuntimeError(f"labels still change after {max_rounds} jumps")


def sample_groups(samples: DataFrame) -> DataFrame:
    """``(sample_id, group_id, last_id)`` of classifier records: same file, or same class in the same language."""
    return related_groups(samples, "sample_id", path_key(F.col("file_path")), class_key(F.col("class_name"), F.col("programming_language")))


def members_of_groups(groups: DataFrame, key: str) -> DataFrame:
    """The rows of groups with at least two different keys, each once."""
    return groups.where(F.col("group_id") < F.col("last_id")).select(key, "group_id").distinct()


def assign_splits(samples: DataFrame, groups: DataFrame, key: str, label: Column, splits=SPLITS) -> DataFrame:
    """``(key, group_id, split)``: whole groups in splits of the given shares with like label distributions.

    Groups with at least 0.1 % of the records (at most 1000) are placed one by one, largest first,
    where the sum of squared deviations from each split's label targets stays least.  The rest fall
    into strata by their most frequent label; each stratum is dealt out over what its label's targets
    still lack, in blocks of about 10,000 groups so that no task holds a stratum.  A null label is a
    stratum like any other.
    """
    labelled = cut_lineage(samples.where(F.col(key).isNotNull()).select(key, F.coalesce(label, F.lit("")).alias("label")).join(groups.select(key, "group_id"), key))
    per_label = labelled.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    group = cut_lineage(per_label.groupBy("group_id").agg(
        F.sum("n").alias("size"), F.max(F.struct(F.col("n"), F.col("label"))).getField("label").alias("main"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("hist"),  # as many entries as labels
    ))
    totals = {r["label"]: r["n"] for r in per_label.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(totals.values())
    limit = max(2, -(-total // 1000))
    placed: dict[str, dict[str, float]] = {s: dict.fromkeys(totals, 0.0) for s, _ in splits}
    big = []
    for row in sorted(group.where(F.col("size") >= limit).collect(), key=lambda r: (-r["size"], r["group_id"])):
        def cost(name: str, share: float, row=row) -> float:
            """How much the squared distance from the targets grows when the group joins the split."""
            have = placed[name]
            return sum(((have[x] + n - share * totals[x]) ** 2 - (have[x] - share * totals[x]) ** 2) / max(share * totals[x], 1) for x, n in row["hist"].items())
        best = min(splits, key=lambda s: cost(*s))[0]
        for x, n in row["hist"].items():
            placed[best][x] += n
        big.append((row["group_id"], best))
    spark = samples.sparkSession
    id_type = group.schema["group_id"].dataType.simpleString()
    big_df = spark.createDataFrame(big, f"group_id {id_type}, split string")
    # cumulative shares of what each label still lacks in each split
    edges = []
    for x in totals:
        lack = [max(share * totals[x] - placed[name][x], 0.0) for name, share in splits]
        whole, upto = sum(lack) or 1.0, 0.0
        for (name, _), part in zip(splits, lack):
            edges.append((x, name, upto / whole, (upto + part) / whole))
            upto += part
    edges_df = spark.createDataFrame(edges, "main string, split string, lo double, hi double")
    small = group.where(F.col("size") < limit)
    blocks = max(1, small.count() // 10_000)
    small = small.withColumn("block", F.pmod(F.xxhash64("group_id"), F.lit(blocks)))
    order = Window.partitionBy("main", "block").orderBy(F.col("size").desc(), F.xxhash64("group_id", F.lit(7)), "group_id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("size").over(Window.partitionBy("main", "block"))
    middle = F.least((upto - F.col("size") / 2) / whole, F.lit(0.999999999))
    dealt = small.select("group_id", "main", middle.alias("at")).join(F.broadcast(edges_df), "main").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("group_id", "split")
    final = big_df.unionByName(dealt)
    sizes = group.select("group_id", "size").join(final, "group_id")
    return hot_cold_join(labelled.select(key, "group_id"), sizes, ["group_id"], "size", total).select(key, "group_id", "split")
