"""Text and classifier operators: TF-IDF, stop words by rule, ambiguities, names of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import text as X


def _document_counts(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, Column]:
    """``(key, token, tf)``, ``(token, df)`` and the number of documents as a one-row broadcast's column."""
    tf = docs.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    return tf, tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")), F.lit(1.0 + docs.count())


def tfidf(docs: DataFrame, key: str) -> DataFrame:
    """``(key, token, weight)`` of ``docs(key, tokens)``: 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1."""
    tf, df, n = _document_counts(docs, key)
    return tf.join(df, "token").select(key, "token", F.round((1 + F.ln("tf")) * (F.ln(n / (1 + F.col("df"))) + 1), 9).alias("weight"))


def hashing_tfidf(docs: DataFrame, key: str, bins: int = 32768) -> DataFrame:
    """``(key, bin, weight)``: TF-IDF over hash bins of the tokens, each document of length 1.

    Every distinct token is hashed once; counts per (document, bin) are combined before the shuffle.
    """
    tf = docs.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    words = tf.select("token").distinct().withColumn("bin", X.hash_bin(X.murmur3("token"), bins))
    hashed = tf.join(words, "token").groupBy(key, "bin").agg(F.sum("tf").alias("tf"))
    df = F.broadcast(hashed.groupBy("bin").agg(F.count(F.lit(1)).alias("df")))  # one row a bin
    w = hashed.join(df, "bin").withColumn("w", (1 + F.ln("tf")) * (F.ln(F.lit(1.0 + docs.count()) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "bin", F.round(F.col("w") / F.col("norm"), 9).alias("weight"))


def frequent_words(docs: DataFrame, key: str, share: float) -> DataFrame:
    """``(token, n_documents)`` of tokens in at least ``share`` of all documents: stop words by rule."""
    counts = docs.select(key, F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_documents"))
    return counts.where(F.col("n_documents") >= F.lit(share) * F.lit(docs.count()))


def pattern_name(first: Column, second: Column) -> Column:
    """Name of the pattern that two labels ``a:b:c`` of one class show; else both layers, or the labels where they have none."""
    part = lambda c, i: F.try_element_at(F.split(c, ":"), F.lit(i))
    l1, l2, c1, c2 = part(first, 3), part(second, 3), part(first, 2), part(second, 2)
    either = lambda x, y, a, b: ((x == a) & (y == b)) | ((x == b) & (y == a))
    return (
        F.when(l1.isNull() | l2.isNull(), F.concat_ws(" + ", first, second))
        .when(either(l1, l2, "entity", "repository"), "entity with persistence code")
        .when(either(c1, c2, "app", "infrastructure"), "service with infrastructure code")
        .when(l1.isin("handler", "controller") & (c2 == "app"), "handler with too much logic")
        .otherwise(F.concat_ws(" + ", l1, l2))
    )


def ambiguities(predictions: DataFrame, key: str, threshold: float = 0.10) -> DataFrame:
    """``(key, gap, labels, pattern)`` of ``predictions(key, predictions)`` whose two best labels lie within ``threshold``, closest first.

    ``labels`` holds up to three labels, joined by ';'.  Rows with fewer than two predictions are not ambiguous.
    """
    p = lambda i: F.get("predictions", F.lit(i))
    gap = p(0)["probability"] - p(1)["probability"]
    close = predictions.where((F.size("predictions") >= 2) & (gap < threshold))
    labels = F.array_join(F.transform(F.slice("predictions", 1, 3), lambda x: x["label"]), ";")
    return close.select(key, F.round(gap, 6).alias("gap"), labels.alias("labels"), pattern_name(p(0)["label"], p(1)["label"]).alias("pattern")).orderBy("gap", key)


#: Name parts that say nothing about a cluster (fixed values).
GENERIC_SEGMENTS = "http common util utils base core internal lib shared api src service services model models".split()


def cluster_names(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(cluster, name)`` of ``members(cluster, name)`` by the words closest to the cluster's centroid.

    Words of the members' names that have a vector ``vectors(word, vec)`` are ranked by cosine to the centroid of all of
    them.  One to three words make the name, by the gap between the first two and the variance of the first five, in
    title case and sorted.  Clusters of fewer than four members, or without a vector, are named by the most frequent part
    of their names but the last that is not generic; 'Miscellaneous' is what is left.
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    parts = members.select("cluster", F.split(F.regexp_replace("name", r"\\|::|/", "."), r"\.").alias("p")).where(F.size("p") > 2).select("cluster", F.element_at("p", -2).alias("part"))
    parts = parts.where(~F.lower("part").isin(GENERIC_SEGMENTS)).groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    fallback = parts.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("minus"), "part")).getField("part").alias("fallback"))
    words = members.select("cluster", F.explode(X.identifier_words(F.element_at(F.split(F.regexp_replace("name", r"\\|::|/", "."), r"\."), -1))).alias("word"))
    known = words.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n")).join(vectors, "word")
    dims = known.select("cluster", "n", F.posexplode("vec").alias("d", "x")).groupBy("cluster", "d").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x"))
    centroid = dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    scored = known.join(centroid, "cluster").select("cluster", "word", F.round(X.cosine("vec", "c"), 9).alias("score"))
    # the five best of a cluster, kept by a bounded state instead of a sort
    best = scored.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "word"))), 1, 5).alias("b"))
    score = F.transform("b", lambda s: -s["minus"])
    mean = F.aggregate(score, F.lit(0.0), lambda a, x: a + x) / F.size("b")
    best = best.withColumn("mean", mean)
    spread = F.aggregate(score, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("b")
    gap = F.get("b", F.lit(1))["minus"] - F.get("b", F.lit(0))["minus"]
    count = F.when(F.size("b") == 1, 1).when((gap > 0.25) & (spread < 0.02), 1).when((spread > 0.06) & (gap < 0.10), 3).otherwise(2)
    named = best.select("cluster", F.array_join(F.array_sort(F.transform(F.slice("b", F.lit(1), count), lambda s: F.initcap(s["word"]))), " ").alias("by_words"))
    joined = size.join(fallback, "cluster", "left").join(named, "cluster", "left")
    small = F.when(F.col("size") < 4, F.col("fallback"))
    return joined.select("cluster", F.coalesce(small, "by_words", "fallback", F.lit("Miscellaneous")).alias("name"))
