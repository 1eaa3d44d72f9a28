"""Roll-ups, activity and coupling (G), joins (F), top lists (I), sets (J) and the query API (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.operators.activity import author_touches, bus_factor, commits_per_month, top_committers
from codeweft.operators import review as V
from codeweft.operators.rollups import MEANS, SUMS, histogram, project_measures, rollup
from codeweft.plans.adapters import CCN, MEASURED, UNITS, measured, reduced_sql, units
from codeweft.plans.metrics import _FR, _H, _RISK, _file_risk
from codeweft.session import load

R = lambda c, n=6: F.round(c, n)


def _measured_files(spark, sf):
    """Measurements with the language, directory and test flag of their file."""
    files = load(spark, sf, "files").select("file_id", "programming_language", "is_test", F.split("short_path", "/")[0].alias("root"))
    return measured(spark, sf).join(files, "file_id", "left")


def g04_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Means and totals over all, by language and by root directory in one pass (G-01 to G-04, G-06)."""
    r = rollup(_measured_files(spark, sf), ["cyclomatic_complexity", "loc"], ["programming_language", "root"])
    return r.select("programming_language", "root", "all_programming_language", "all_root", "n", *[F.col(f"{m}_{a}") for m in ("cyclomatic_complexity", "loc") for a in ("sum", "min", "max", "count")], R(F.col("cyclomatic_complexity_avg")).alias("ccn_avg"), R(F.col("loc_avg")).alias("loc_avg"))


def g05_counts(spark, sf):
    """Files, test files, classes, functions and classes with code by repo."""
    m = _measured_files(spark, sf)
    return m.groupBy("repo").agg(
        F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if((F.col("kind") == "file") & F.col("is_test")).alias("n_test_files"), F.count_if(F.col("kind") == "class").alias("n_classes"),
        F.count_if(F.col("kind") == "function").alias("n_functions"), F.count_if((F.col("kind") == "class") & (F.col("loc") > 0)).alias("n_classes_with_code"),
    )


def g06_mixed_means(spark, sf):
    """Means over functions and classes together, per function and per class."""
    m = measured(spark, sf)
    mi, ccn = F.col("maintainability_index"), F.col("cyclomatic_complexity")
    both, fn, cl = F.col("kind").isin("class", "function"), F.col("kind") == "function", F.col("kind") == "class"
    return m.groupBy("repo").agg(R(F.avg(F.when(both, mi))).alias("avg_mi"), R(F.avg(F.when(fn, mi))).alias("avg_mi_per_method"), R(F.avg(F.when(both, ccn))).alias("avg_ccn"), R(F.avg(F.when(cl, ccn))).alias("avg_ccn_per_class"))


def _deps(spark, sf):
    """Dependencies: lines as uses of a brand (namespace) by a customer nation's class (order's customer)."""
    o, l, p = load(spark, sf, "orders"), load(spark, sf, "lineitem"), load(spark, sf, "part")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("owner"), F.col("p_brand").alias("namespace"), F.col("p_type").alias("class_name"), (F.col("o_custkey") % 97).alias("file_id"))


_DEPS = "deps AS (SELECT o_custkey AS owner, p_brand AS namespace, p_type AS class_name, o_custkey % 97 AS file_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def g07_coupling(spark, sf):
    """Efferent coupling of each class and afferent coupling of each namespace (G-07 to G-09), instability of each."""
    d = _deps(spark, sf)
    return d.groupBy("owner").agg(F.count_distinct(F.when(F.col("class_name") != "", F.col("namespace"))).alias("efferent"), F.count_distinct("class_name").alias("used_classes"))


def g08_afferent(spark, sf):
    """Classes that depend on each namespace."""
    return _deps(spark, sf).groupBy("namespace").agg(F.count_distinct("owner").alias("afferent"), F.count(F.lit(1)).alias("uses"))


def g10_package_relations(spark, sf):
    """Packages reduced to depth 2 with the number of relations; self relations dropped (G-10)."""
    e = load(spark, sf, "edges").select(M.reduce_namespace("src", 2).alias("src"), M.reduce_namespace("dst", 2).alias("dst"), "weight")
    return e.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))


def g10_file_relations(spark, sf):
    """Package relations by file: of the dependencies of one class of a file the last counts (G-10, last wins)."""
    m = measured(spark, sf).where("kind = 'function' and item_name is not null")
    last = m.groupBy("file_id", F.split("item_name", r"\.")[0].alias("src")).agg(F.max_by(F.split("item_name", r"\.")[1], "item_id").alias("dst"))
    return last.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def g23_dependency_weights(spark, sf):
    """Packages reduced to depth 3: weight of each relation and its share of the source's whole (G-23, K-01)."""
    e = load(spark, sf, "edges").select(M.reduce_namespace("src", 3).alias("src"), M.reduce_namespace("dst", 3).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    whole = e.groupBy("src").agg(F.sum("n").alias("n_src"))
    return e.join(whole, "src").select("src", "dst", "n", "n_src", R(F.col("n") / F.col("n_src")).alias("share"))


def _measure_tables(spark, sf, months: str = "true"):
    """Functions and classes of the contract tables with all measures, for ``project_measures``; ``months`` picks a revision."""
    u = units(spark, sf).join(load(spark, sf, "orders").where(months).select(F.col("o_orderkey").alias("unit_id")), "unit_id", "left_semi").withColumn("ccn", M.cyclomatic()).withColumnRenamed("language", "scope")
    for name, value in M.halstead("n_distinct_operators", "n_distinct_operands", "n_operators", "n_operands").items():
        u = u.withColumn(name, value)
    index = M.maintainability("loc", "lloc", "cloc", "ccn", "h_volume")
    f = u.select("*", *[v.alias(k) for k, v in index.items()])
    c = u.groupBy("scope", "class_id").agg(F.count(F.lit(1)).alias("n_methods"), *[F.sum(x).alias(x) for x in ("loc", "lloc", "cloc", "ccn")], *[F.avg(x).alias(x) for x in ("h_difficulty", "h_effort", "h_volume", "h_time", "h_bugs")])
    used = _deps(spark, sf).groupBy(F.col("owner").alias("class_id")).agg(F.count_distinct("namespace").alias("efferent"))
    c = c.join(used, "class_id", "left").withColumn("afferent", F.lit(0)).withColumn("efferent", F.coalesce("efferent", F.lit(0))).withColumn("instability", M.class_instability("efferent", "afferent"))
    return f, c.select("*", *[v.alias(k) for k, v in index.items()])


def g03_measures(spark, sf):
    """Means of all measures, sums, extremes and counts by language (G-03)."""
    m = project_measures(*_measure_tables(spark, sf))
    return m.select("scope", *[R(F.col(c).cast("double")).alias(c) for c in m.columns if c != "scope"])


def m01_aggregate_delta(spark, sf):
    """Current minus compared of all measures by language, the halves of the year as revisions (M-01)."""
    head, base = (project_measures(*_measure_tables(spark, sf, w)) for w in ("month(o_orderdate) > 6", "month(o_orderdate) <= 6"))
    return V.measure_deltas(head, base, [c for c in head.columns if c != "scope"])


def g11_project_instability(spark, sf):
    """Efferent over all coupling of each repo's classes."""
    m = measured(spark, sf).where("kind = 'class'")
    ce, ca = F.sum("efferent"), F.sum("afferent")
    return m.groupBy("repo").agg(R(F.when(ce + ca > 0, ce / (ce + ca)).otherwise(0.0)).alias("instability"))


def g12_commit_counts(spark, sf):
    """Commits, files touched, commits touching known files and authors of each repo."""
    c = load(spark, sf, "commits")
    return c.groupBy("repo").agg(F.count_distinct("hash").alias("n_commits"), F.count_distinct(F.when(F.col("file_id").isNotNull(), F.col("hash"))).alias("n_analysed"), F.count_distinct("file_id").alias("n_files"), F.count_distinct("author").alias("n_authors"))


def g12_file_commits(spark, sf):
    """Commits and committers of each file, files without commits included (F-01)."""
    c = load(spark, sf, "commits").where("file_id is not null").groupBy("file_id").agg(F.count_distinct("repo", "hash").alias("n_commits"), F.count_distinct("author").alias("n_committers"))
    return load(spark, sf, "files").select("file_id").join(c, "file_id", "left").select("file_id", F.coalesce("n_commits", F.lit(0)).alias("n_commits"), F.coalesce("n_committers", F.lit(0)).alias("n_committers"))


def g13_bus_factor(spark, sf):
    """Bus factor of each repo."""
    return bus_factor(author_touches(load(spark, sf, "commits"), ["repo"]), ["repo"])


def g14_top_committers(spark, sf):
    """The four authors with most touches of each repo."""
    return top_committers(author_touches(load(spark, sf, "commits"), ["repo"]), ["repo"])


def g15_community_bus_factor(spark, sf):
    """Bus factor by the first folder of the files; only '' and null are left out as authors."""
    files = load(spark, sf, "files").select("file_id", F.split("short_path", "/")[0].alias("community"))
    c = load(spark, sf, "commits").join(files, "file_id")
    return bus_factor(author_touches(c, ["community"], [""]), ["community"])


def g17_isolation_histogram(spark, sf):
    """Classes by isolation score in five bins of 20."""
    s = measured(spark, sf).where("kind = 'class'").select(M.isolation_score("efferent", F.col("afferent") % 4).alias("s"))
    return s.groupBy(F.least(F.floor(F.col("s") / 20), F.lit(4)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def g18_ccn_histogram(spark, sf):
    return histogram(measured(spark, sf).where("kind = 'function'"), F.col("cyclomatic_complexity"), [("<5", 5), ("<20", 20), (">=20", None)])


def g19_loc_histogram(spark, sf):
    return histogram(measured(spark, sf).where("kind = 'function'"), F.col("loc"), [("<15", 15), ("<35", 35), ("<50", 50), (">=50", None)])


def g20_mi_histogram(spark, sf):
    """Classes, and files without any, by maintainability index (G-20)."""
    m = measured(spark, sf)
    classes = m.where("kind = 'class'")
    alone = m.where("kind = 'file'").join(classes.select("file_id").distinct(), "file_id", "left_anti").select("maintainability_index")
    return histogram(classes.select("maintainability_index").unionByName(alone), F.col("maintainability_index"), [("<64", 64), ("<85", 85), (">=85", None)])


def g22_commits_per_month(spark, sf):
    return commits_per_month(load(spark, sf, "commits"), 2024)


def g25_labels(spark, sf):
    """Classes of each label, and of each family with label (G-25, L-13)."""
    s = load(spark, sf, "class_samples").where("label is not null")
    return s.groupBy(F.split("label", ":")[0].alias("family"), "label").agg(F.count(F.lit(1)).alias("n"))


def g27_distinct_lists(spark, sf):
    """Distinct packages that each package uses, as a sorted list."""
    e = load(spark, sf, "edges").where("src is not null and dst is not null").select("repo", "src", "dst").distinct()
    return e.groupBy("repo", "src").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("dst")), ";").alias("uses"))


def g28_balanced_sample(spark, sf):
    """At most 50 records of each label, drawn by a hash of the id."""
    s = load(spark, sf, "class_samples").where("label is not null")
    w = Window.partitionBy("label").orderBy(F.xxhash64("sample_id"), "sample_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 50").select("sample_id", "label")


def _class_names(spark, sf):
    """Classes and the dependencies on classes by qualified name: folders of the path, then the class (a function is named ``Class.method``)."""
    m = measured(spark, sf).where("item_name is not null")
    full = F.concat_ws(".", F.replace(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("/"), F.lit(".")), F.split("item_name", r"\.")[0])
    classes = m.where("kind = 'class'").groupBy("repo", full.alias("qualified")).agg(F.min("file_id").alias("owner"))
    return classes, m.where("kind = 'function'").groupBy("repo", full.alias("qualified")).agg(F.count(F.lit(1)).alias("n_uses"))


def f02_resolved_dependencies(spark, sf):
    """Dependencies with the class they resolve to by qualified name, unresolved ones kept (F-02, left join)."""
    classes, uses = _class_names(spark, sf)
    return uses.join(classes, ["repo", "qualified"], "left").select("repo", "qualified", "n_uses", "owner")


def f03_dependency_files(spark, sf):
    """Dependencies with the files of their reduced path: both sides cut to two parts, unresolved ones kept (F-03, left join)."""
    e = load(spark, sf, "edges").where("dst is not null").select("repo", M.reduce_namespace("dst", 2).alias("reduced")).groupBy("repo", "reduced").agg(F.count(F.lit(1)).alias("n_uses"))
    folder = F.replace(F.regexp_replace("short_path", "/?[^/]*$", ""), F.lit("/"), F.lit("."))
    f = load(spark, sf, "files").select("repo", M.reduce_namespace(F.regexp_replace(folder, r"^[^.]*\.", ""), 2).alias("reduced"), "file_id").groupBy("repo", "reduced").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n_files"))
    return e.join(f, ["repo", "reduced"], "left").select("repo", "reduced", "n_uses", "file_id", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def f10_longest_prefix(spark, sf):
    """Each file with the deepest of the analysed directories it lies in, by equality on every ancestor."""
    files = load(spark, sf, "files").select("file_id", "repo", "short_path")
    dirs = files.select("repo", F.array_join(F.slice(F.split("short_path", "/"), 1, 2), "/").alias("dir")).where(F.size(F.split("dir", "/")) == 2).groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("repo", "dir")
    parts = F.split("short_path", "/")
    ancestors = files.where(F.size(parts) > 1).select("file_id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(F.split("short_path", "/"), F.lit(1), i), "/"))).alias("dir"))
    return ancestors.join(dirs, ["repo", "dir"]).groupBy("file_id").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def f14_author_mail(spark, sf):
    """Each author's first known address by commit time."""
    c = load(spark, sf, "commits").where("author is not null and author <> '' and email is not null and email <> '' and ts > 0")
    return c.groupBy("author").agg(F.min(F.struct("ts", "email")).getField("email").alias("email"))


def f17_forbidden(spark, sf):
    """Dependencies that a forbidden pair of patterns matches, one row per pair and dependency; the few rules are broadcast."""
    rules = spark.createDataFrame([("^core", "shared|common"), ("\\.ledger$", "\\.token$"), ("INTERNAL", "^common")], "from_pattern string, to_pattern string")
    e = load(spark, sf, "edges").select("repo", "src", "dst").distinct()
    hit = F.expr("src rlike concat('(?i)', from_pattern) and dst rlike concat('(?i)', to_pattern)")
    return e.join(F.broadcast(rules), hit).select("repo", "src", "dst", "from_pattern", "to_pattern")


def f18_labels(spark, sf):
    """Samples joined to the labels of an equal class and file."""
    s = load(spark, sf, "class_samples").where("class_name is not null and file_path is not null")
    labels = s.where("label is not null").select("class_name", "file_path", "label").distinct()
    return s.select("sample_id", "class_name", "file_path").join(labels, ["class_name", "file_path"]).select("sample_id", "label")


def i06_lowest_maintainability(spark, sf, low: float = 1, high: float = 65, limit: int = 10):
    """Classes of lowest index within [``low``, ``high``] of non-test files (I-06)."""
    m = _measured_files(spark, sf).where((F.col("kind") == "class") & ~F.coalesce("is_test", F.lit(False)) & F.col("maintainability_index").between(low, high))
    return m.select("item_id", R(F.col("maintainability_index")).alias("mi")).orderBy("mi", "item_id").limit(limit)


#: Orders of the class table and of the file table: names and the maintainability index ascending, all other numbers descending.
CLASS_ORDERS = {"name": lambda: F.col("item_name").asc_nulls_last(), "mi": lambda: F.col("maintainability_index").asc_nulls_last(), **{k: (lambda c=c: F.col(c).desc_nulls_last()) for k, c in (("loc", "loc"), ("ccn", "cyclomatic_complexity"), ("afferent", "afferent"), ("efferent", "efferent"))}}


def i09_class_table(spark, sf, by: str = "name"):
    """Classes in the order ``by`` of the class table (I-09); ties by id."""
    c = measured(spark, sf).where("kind = 'class'").select("item_id", "item_name", "loc", "cyclomatic_complexity", R(F.col("maintainability_index")).alias("maintainability_index"), "afferent", "efferent")
    return c.orderBy(CLASS_ORDERS[by](), "item_id")


def i14_top_edges(spark, sf):
    """The five heaviest targets of each package."""
    e = load(spark, sf, "edges").where("src is not null and dst is not null").groupBy("repo", "src", "dst").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
    w = Window.partitionBy("repo", "src").orderBy(F.col("weight").desc(), "dst")
    return e.withColumn("place", F.row_number().over(w)).where("place <= 5")


def j03_added_deleted(spark, sf):
    """Paths of each repo that the repo before it by name lacks, and the reverse: the repos in order as revisions (anti joins)."""
    f = load(spark, sf, "files").select("repo", "short_path").distinct()
    repos = f.select("repo").distinct()  # a window over the few names of repos
    pairs = repos.select("repo", F.lag("repo").over(Window.orderBy("repo")).alias("before")).where("before is not null")
    head = f.join(F.broadcast(pairs), "repo").select("repo", "before", "short_path")
    base = f.withColumnRenamed("repo", "before").join(F.broadcast(pairs), "before").select("repo", "before", "short_path")
    keys = ["repo", "before", "short_path"]
    return head.join(base, keys, "left_anti").withColumn("status", F.lit("added")).unionByName(base.join(head, keys, "left_anti").withColumn("status", F.lit("deleted")))


def n01_overview(spark, sf):
    """Project overview of each repo: files, languages, mean complexity and index, lines."""
    m = _measured_files(spark, sf)
    f = m.where("kind = 'file'")
    return f.groupBy("repo").agg(F.count_distinct("file_id").alias("n_files"), F.count_distinct("programming_language").alias("n_languages"), R(F.avg("cyclomatic_complexity")).alias("avg_ccn"), R(F.avg("maintainability_index")).alias("avg_mi"), F.sum("loc").alias("loc"))


def n02_file_metrics(spark, sf, suffix: str = "go"):
    """Measurements of the files whose path equals or ends with ``suffix``."""
    return measured(spark, sf).where((F.col("kind") == "file") & ((F.col("path") == suffix) | F.col("path").endswith(suffix))).select("file_id", "path", "cyclomatic_complexity", "loc", R(F.col("maintainability_index")).alias("mi"))


def n03_find_risky_code(spark, sf, min_risk: float = 0.1, limit: int = 20):
    """The files of highest risk (I-01, I-07)."""
    return _file_risk(spark, sf).where(F.col("risk") >= min_risk).select("file_id", R(F.col("risk")).alias("risk")).orderBy(F.col("risk").desc(), "file_id").limit(limit)


def n04_find_complex_code(spark, sf, max_cyclomatic: int = 10, limit: int = 20):
    """The most complex functions and classes from ``max_cyclomatic`` on (I-02)."""
    u = units(spark, sf).withColumn("ccn", M.cyclomatic())
    functions = u.select(F.lit("function").alias("kind"), F.col("unit_id").alias("id"), "ccn")
    classes = u.groupBy(F.col("class_id").alias("id")).agg(F.sum("ccn").alias("ccn")).select(F.lit("class").alias("kind"), "id", "ccn")
    return functions.unionByName(classes).where(F.col("ccn") >= max_cyclomatic).orderBy(F.col("ccn").desc(), "kind", "id").limit(limit)


def n09_list_components(spark, sf):
    """Components (package folders) with files, classes and lines."""
    return _measured_files(spark, sf).groupBy("repo", "root").agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") == "class").alias("n_classes"), F.sum(F.when(F.col("kind") == "file", F.col("loc"))).alias("loc"))


_MF = f"{MEASURED}, mf AS (SELECT m.*, f.programming_language, f.is_test, split_part(f.short_path, '/', 1) AS root FROM measured m LEFT JOIN files f ON f.file_id = m.file_id)"


def _bus(source: str, by: str) -> str:
    return f"""WITH t AS (SELECT {by}, author, count(*) AS touches FROM {source} GROUP BY {by}, author),
        r AS (SELECT *, sum(touches) OVER (PARTITION BY {by}) AS total, sum(touches) OVER (PARTITION BY {by} ORDER BY touches DESC, author ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY {by} ORDER BY touches DESC, author) AS rank FROM t)"""


def _hist(source: str, value: str, buckets: list[tuple[str, str]]) -> str:
    case = "CASE " + " ".join(f"WHEN {value} {cond} THEN '{name}'" for name, cond in buckets) + " END"
    names = ", ".join(f"('{name}')" for name, _ in buckets)
    return f"SELECT b.bucket, coalesce(n, 0) AS n FROM (VALUES {names}) b(bucket) LEFT JOIN (SELECT {case} AS bucket, count(*) AS n FROM {source} GROUP BY 1) c ON c.bucket = b.bucket"


_NAMED = "(SELECT * FROM commits WHERE author IS NOT NULL AND author NOT IN ('', 'noreply@github.com'))"

QUERIES = {f.__name__: f for f in (
    g04_rollup, g05_counts, g06_mixed_means, g07_coupling, g08_afferent, g10_package_relations, g10_file_relations, g23_dependency_weights, g03_measures, m01_aggregate_delta, g11_project_instability, g12_commit_counts, g12_file_commits, g13_bus_factor, g14_top_committers, g15_community_bus_factor,
    g17_isolation_histogram, g18_ccn_histogram, g19_loc_histogram, g20_mi_histogram, g22_commits_per_month, g25_labels, g27_distinct_lists, g28_balanced_sample, f02_resolved_dependencies, f03_dependency_files,
    f10_longest_prefix, f14_author_mail, f17_forbidden, f18_labels, i06_lowest_maintainability, i09_class_table, i14_top_edges, j03_added_deleted, n01_overview, n02_file_metrics, n03_find_risky_code, n04_find_complex_code, n09_list_components,
)}

_AGG = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}_sum, min(nullif({m}, 0)) AS {m}_min, max({m}) AS {m}_max, count({m}) AS {m}_count" for m in ("cyclomatic_complexity", "loc"))
_REDUCE = "CASE WHEN len(string_split_regex({c}, '[^A-Za-z0-9]+')) <= 2 THEN {c} ELSE string_split_regex({c}, '[^A-Za-z0-9]+')[1] || regexp_extract({c}, '[^A-Za-z0-9]+') || string_split_regex({c}, '[^A-Za-z0-9]+')[2] END"

def _measures(name: str, where: str = "true") -> str:
    """CTE ``name`` with the columns of ``project_measures`` over the units of the orders that ``where`` picks."""
    mi = "CASE WHEN h_volume > 0 THEN CASE WHEN lloc > 0 THEN greatest(0.0, (171 - 5.2 * ln(h_volume) - 0.23 * ccn - 16.2 * ln(lloc)) * 100 / 171) ELSE 0.0 END END"
    cw = "CASE WHEN h_volume > 0 THEN CASE WHEN loc > 0 THEN 50 * sin(sqrt(2.4 * cloc / loc)) ELSE 0.0 END END"
    pick = {"f": "FILTER (kind = 'f')", "c": "FILTER (kind = 'c')", "b": ""}
    aggs = [f"avg({x}) {pick[k]} AS avg_{m}" for m, (k, x) in MEANS.items()] + [f"sum({x}) AS sum_{x}" for x in SUMS]
    aggs += ["min(nullif(ccn, 0)) FILTER (kind = 'f') AS min_ccn", "max(ccn) FILTER (kind = 'f') AS max_ccn", "count(*) FILTER (kind = 'f') AS n_methods", "count(*) FILTER (kind = 'c') AS n_classes", "count(*) FILTER (kind = 'c' AND loc > 0) AS n_classes_with_code"]
    own = ["loc", "lloc", "cloc", "ccn", "h_difficulty", "h_effort", "h_volume", "h_time", "h_bugs"]
    return f"""{name}_u AS (SELECT language AS scope, class_id, {CCN} AS ccn, loc, lloc, cloc, h_difficulty, h_difficulty * h_volume AS h_effort, h_volume, h_difficulty * h_volume / 18 AS h_time, CASE WHEN h_volume > 0 THEN h_volume / 3000 END AS h_bugs FROM h WHERE unit_id IN (SELECT o_orderkey FROM orders WHERE {where})),
        {name}_c AS (SELECT scope, u.class_id, count(*) AS n_methods, {', '.join(f'CAST(sum({x}) AS DOUBLE) AS {x}' for x in own[:4])}, {', '.join(f'avg({x}) AS {x}' for x in own[4:])}, any_value(coalesce(ce, 0)) AS efferent FROM {name}_u u LEFT JOIN eff ON eff.owner = u.class_id GROUP BY 1, 2),
        {name}_b AS (SELECT scope, 'f' AS kind, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in own)}, NULL::DOUBLE AS n_methods, NULL::DOUBLE AS afferent, NULL::DOUBLE AS efferent, NULL::DOUBLE AS instability FROM {name}_u
            UNION ALL SELECT scope, 'c', {', '.join(own)}, n_methods, 0, efferent, 0.0 FROM {name}_c),
        {name}_m AS (SELECT *, {mi} AS mi_woc, {cw} AS comment_weight, {mi} + {cw} AS mi FROM {name}_b), {name} AS (SELECT scope, {', '.join(aggs)} FROM {name}_m GROUP BY scope)"""


_MEASURES = [f"avg_{m}" for m in MEANS] + [f"sum_{x}" for x in SUMS] + ["min_ccn", "max_ccn", "n_methods", "n_classes", "n_classes_with_code"]
_EFF = f"{_DEPS}, eff AS (SELECT owner, count(DISTINCT namespace) AS ce FROM deps GROUP BY 1)"

SQL = {
    "g04_rollup": f"WITH {_MF} SELECT programming_language, root, CAST(grouping(programming_language) AS TINYINT) AS all_programming_language, CAST(grouping(root) AS TINYINT) AS all_root, count(*) AS n, {_AGG}, round(avg(cyclomatic_complexity), 6) AS ccn_avg, round(avg(loc), 6) AS loc_avg FROM mf GROUP BY GROUPING SETS ((), (programming_language), (root))",
    "g05_counts": f"WITH {_MF} SELECT repo, count(*) FILTER (kind = 'file') AS n_files, count(*) FILTER (kind = 'file' AND is_test) AS n_test_files, count(*) FILTER (kind = 'class') AS n_classes, count(*) FILTER (kind = 'function') AS n_functions, count(*) FILTER (kind = 'class' AND loc > 0) AS n_classes_with_code FROM mf GROUP BY repo",
    "g06_mixed_means": f"WITH {MEASURED} SELECT repo, round(avg(maintainability_index) FILTER (kind IN ('class', 'function')), 6) AS avg_mi, round(avg(maintainability_index) FILTER (kind = 'function'), 6) AS avg_mi_per_method, round(avg(cyclomatic_complexity) FILTER (kind IN ('class', 'function')), 6) AS avg_ccn, round(avg(cyclomatic_complexity) FILTER (kind = 'class'), 6) AS avg_ccn_per_class FROM measured GROUP BY repo",
    "g07_coupling": f"WITH {_DEPS} SELECT owner, count(DISTINCT CASE WHEN class_name <> '' THEN namespace END) AS efferent, count(DISTINCT class_name) AS used_classes FROM deps GROUP BY owner",
    "g08_afferent": f"WITH {_DEPS} SELECT namespace, count(DISTINCT owner) AS afferent, count(*) AS uses FROM deps GROUP BY namespace",
    "g10_package_relations": f"WITH e AS (SELECT {_REDUCE.format(c='src')} AS src, {_REDUCE.format(c='dst')} AS dst, weight FROM edges) SELECT src, dst, count(*) AS n, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight FROM e WHERE src <> dst GROUP BY src, dst",
    "g11_project_instability": "SELECT repo, round(CASE WHEN sum(efferent) + sum(afferent) > 0 THEN sum(efferent) / (sum(efferent) + sum(afferent))::DOUBLE ELSE 0.0 END, 6) AS instability FROM metrics WHERE kind = 'class' GROUP BY repo",
    "g12_commit_counts": "SELECT repo, count(DISTINCT hash) AS n_commits, count(DISTINCT CASE WHEN file_id IS NOT NULL THEN hash END) AS n_analysed, count(DISTINCT file_id) AS n_files, count(DISTINCT author) AS n_authors FROM commits GROUP BY repo",
    "g12_file_commits": "SELECT f.file_id, coalesce(n_commits, 0) AS n_commits, coalesce(n_committers, 0) AS n_committers FROM files f LEFT JOIN (SELECT file_id, count(DISTINCT repo || ' ' || hash) AS n_commits, count(DISTINCT author) AS n_committers FROM commits WHERE file_id IS NOT NULL GROUP BY file_id) c ON c.file_id = f.file_id",
    "g13_bus_factor": _bus(_NAMED, "repo") + "SELECT repo, min(rank) AS bus_factor, CAST(max(total) AS BIGINT) AS total FROM r WHERE upto >= total // 2 GROUP BY repo",
    "g14_top_committers": _bus(_NAMED, "repo") + "SELECT repo, rank, author, touches, round(touches * 100 / total::DOUBLE, 6) AS percentage FROM r WHERE rank <= 4",
    "g15_community_bus_factor": _bus("(SELECT c.author, split_part(short_path, '/', 1) AS community FROM commits c JOIN files f ON f.file_id = c.file_id WHERE author <> '')", "community") + "SELECT community, min(rank) AS bus_factor, CAST(max(total) AS BIGINT) AS total FROM r WHERE upto >= total // 2 GROUP BY community",
    "g17_isolation_histogram": "SELECT CAST(least(greatest(0, least(100, 100 - 10 * efferent - 5 * (afferent % 4))) // 20, 4) AS INTEGER) AS bin, count(*) AS n FROM metrics WHERE kind = 'class' GROUP BY 1",
    "g18_ccn_histogram": _hist("metrics WHERE kind = 'function' AND cyclomatic_complexity IS NOT NULL", "cyclomatic_complexity", [("<5", "< 5"), ("<20", "< 20"), (">=20", ">= 20")]),
    "g19_loc_histogram": _hist("metrics WHERE kind = 'function' AND loc IS NOT NULL", "loc", [("<15", "< 15"), ("<35", "< 35"), ("<50", "< 50"), (">=50", ">= 50")]),
    "g20_mi_histogram": _hist("(SELECT maintainability_index FROM metrics m WHERE kind = 'class' OR (kind = 'file' AND file_id NOT IN (SELECT file_id FROM metrics WHERE kind = 'class'))) WHERE maintainability_index IS NOT NULL AND NOT isnan(maintainability_index)", "maintainability_index", [("<64", "< 64"), ("<85", "< 85"), (">=85", ">= 85")]),
    "g22_commits_per_month": "SELECT m AS month, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][m] AS label, coalesce(n, 0) AS n_commits FROM (SELECT CAST(range AS INTEGER) AS m FROM range(1, 13)) s LEFT JOIN (SELECT month(to_timestamp(ts) AT TIME ZONE 'UTC') AS k, count(DISTINCT repo || ' ' || hash) AS n FROM commits WHERE ts > 0 AND ts < 4102444800 AND year(to_timestamp(ts) AT TIME ZONE 'UTC') = 2024 GROUP BY 1) c ON c.k = s.m",
    "g25_labels": "SELECT split_part(label, ':', 1) AS family, label, count(*) AS n FROM class_samples WHERE label IS NOT NULL GROUP BY 1, 2",
    "g27_distinct_lists": "SELECT repo, src, count(*) AS n, string_agg(dst, ';' ORDER BY dst) AS uses FROM (SELECT DISTINCT repo, src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY repo, src",
    "f02_resolved_dependencies": f"""WITH {MEASURED}, q AS (SELECT *, replace(regexp_replace(path, '/?[^/]*$', ''), '/', '.') || '.' || split_part(item_name, '.', 1) AS qualified FROM measured WHERE item_name IS NOT NULL), c AS (SELECT repo, qualified, min(file_id) AS owner FROM q WHERE kind = 'class' GROUP BY 1, 2),
        u AS (SELECT repo, qualified, count(*) AS n_uses FROM q WHERE kind = 'function' GROUP BY 1, 2) SELECT u.repo, u.qualified, n_uses, owner FROM u LEFT JOIN c ON c.repo = u.repo AND c.qualified = u.qualified""",
    "f10_longest_prefix": """WITH p AS (SELECT file_id, repo, short_path, array_to_string(string_split(short_path, '/')[1:2], '/') AS d2 FROM files),
        d AS (SELECT repo, d2 AS dir FROM p WHERE contains(d2, '/') GROUP BY repo, d2 HAVING count(*) >= 2)
        SELECT file_id, arg_max(dir, length(dir)) AS dir FROM p JOIN d ON d.repo = p.repo AND starts_with(short_path, dir || '/') GROUP BY file_id""",
    "f14_author_mail": "SELECT author, first(email ORDER BY ts, email) AS email FROM commits WHERE author IS NOT NULL AND author <> '' AND email IS NOT NULL AND email <> '' AND ts > 0 GROUP BY author",
    "f17_forbidden": "SELECT DISTINCT repo, src, dst, a AS from_pattern, b AS to_pattern FROM edges JOIN (VALUES ('^core', 'shared|common'), ('\\.ledger$', '\\.token$'), ('INTERNAL', '^common')) r(a, b) ON regexp_matches(src, '(?i)' || a) AND regexp_matches(dst, '(?i)' || b)",
    "f18_labels": "SELECT sample_id, l.label FROM class_samples s JOIN (SELECT DISTINCT class_name, file_path, label FROM class_samples WHERE label IS NOT NULL) l ON l.class_name = s.class_name AND l.file_path = s.file_path",
    "i06_lowest_maintainability": f"WITH {_MF} SELECT item_id, round(maintainability_index, 6) AS mi FROM mf WHERE kind = 'class' AND NOT coalesce(is_test, false) AND maintainability_index BETWEEN 1 AND 65 ORDER BY 2, 1 LIMIT 10",
    "i09_class_table": f"WITH {MEASURED} SELECT item_id, item_name, loc, cyclomatic_complexity, round(maintainability_index, 6) AS maintainability_index, afferent, efferent FROM measured WHERE kind = 'class'",
    "i14_top_edges": "SELECT * FROM (SELECT repo, src, dst, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight, row_number() OVER (PARTITION BY repo, src ORDER BY coalesce(sum(weight), 0) DESC, dst) AS place FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY repo, src, dst) WHERE place <= 5",
    "j03_added_deleted": """WITH f AS (SELECT DISTINCT repo, short_path FROM files), p AS (SELECT * FROM (SELECT repo, lag(repo) OVER (ORDER BY repo) AS before FROM (SELECT DISTINCT repo FROM f)) WHERE before IS NOT NULL), h AS (SELECT p.repo, p.before, short_path FROM f JOIN p ON p.repo = f.repo), b AS (SELECT p.repo, p.before, short_path FROM f JOIN p ON p.before = f.repo)
        SELECT *, 'added' AS status FROM (SELECT * FROM h EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM b EXCEPT SELECT * FROM h)""",
    "n01_overview": f"WITH {_MF} SELECT repo, count(DISTINCT file_id) AS n_files, count(DISTINCT programming_language) AS n_languages, round(avg(cyclomatic_complexity), 6) AS avg_ccn, round(avg(maintainability_index), 6) AS avg_mi, CAST(sum(loc) AS BIGINT) AS loc FROM mf WHERE kind = 'file' GROUP BY repo",
    "n02_file_metrics": f"WITH {MEASURED} SELECT file_id, path, cyclomatic_complexity, loc, round(maintainability_index, 6) AS mi FROM measured WHERE kind = 'file' AND ends_with(path, 'go')",
    "n03_find_risky_code": f"WITH {_FR}, t AS (SELECT max(n_commits) AS tc, max(ccn) AS tv FROM f) SELECT file_id, round({_RISK.format(tc='tc', c='n_commits', tv='tv', v='coalesce(ccn, 0)')}, 6) AS risk FROM f, t WHERE {_RISK.format(tc='tc', c='n_commits', tv='tv', v='coalesce(ccn, 0)')} >= 0.1 ORDER BY 2 DESC, 1 LIMIT 20",
    "n04_find_complex_code": f"WITH {UNITS} SELECT * FROM (SELECT 'function' AS kind, unit_id AS id, CAST({CCN} AS BIGINT) AS ccn FROM units UNION ALL SELECT 'class', class_id, CAST(sum({CCN}) AS BIGINT) FROM units GROUP BY class_id) WHERE ccn >= 10 ORDER BY ccn DESC, kind, id LIMIT 20",
    "n09_list_components": f"WITH {_MF} SELECT repo, root, count(*) FILTER (kind = 'file') AS n_files, count(*) FILTER (kind = 'class') AS n_classes, CAST(sum(loc) FILTER (kind = 'file') AS BIGINT) AS loc FROM mf GROUP BY repo, root",
    "f03_dependency_files": f"""WITH e AS (SELECT repo, {_REDUCE.format(c='dst')} AS reduced, count(*) AS n_uses FROM edges WHERE dst IS NOT NULL GROUP BY 1, 2), p AS (SELECT repo, file_id, regexp_replace(replace(regexp_replace(short_path, '/?[^/]*$', ''), '/', '.'), '^[^.]*\\.', '') AS d FROM files),
        f AS (SELECT repo, {_REDUCE.format(c='d')} AS reduced, min(file_id) AS file_id, count(*) AS n_files FROM p GROUP BY 1, 2) SELECT e.repo, e.reduced, n_uses, file_id, coalesce(n_files, 0) AS n_files FROM e LEFT JOIN f ON f.repo = e.repo AND f.reduced = e.reduced""",
    "g10_file_relations": "WITH l AS (SELECT file_id, split_part(item_name, '.', 1) AS src, arg_max(split_part(item_name, '.', 2), item_id) AS dst FROM metrics WHERE kind = 'function' AND item_name IS NOT NULL GROUP BY 1, 2) SELECT src, dst, count(*) AS n FROM l GROUP BY 1, 2",
    "g23_dependency_weights": f"WITH e AS (SELECT {reduced_sql('src', 3)} AS src, {reduced_sql('dst', 3)} AS dst FROM edges), g AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY 1, 2) SELECT src, dst, n, CAST(sum(n) OVER (PARTITION BY src) AS BIGINT) AS n_src, round(n / sum(n) OVER (PARTITION BY src)::DOUBLE, 6) AS share FROM g",
    "g03_measures": f"WITH {UNITS}, {_H}, {_EFF}, {_measures('r')} SELECT scope, {', '.join(f'round(CAST({x} AS DOUBLE), 6) AS {x}' for x in _MEASURES)} FROM r",
    "m01_aggregate_delta": f"WITH {UNITS}, {_H}, {_EFF}, {_measures('a', 'month(o_orderdate) > 6')}, {_measures('b', 'month(o_orderdate) <= 6')} SELECT coalesce(a.scope, b.scope) AS scope, {', '.join(f'round(coalesce(CAST(a.{x} AS DOUBLE), 0) - coalesce(CAST(b.{x} AS DOUBLE), 0), 6) AS delta_{x}' for x in _MEASURES)} FROM a FULL JOIN b ON b.scope = a.scope",
}
