"""Queries over extracted code: from source text to metrics, dependencies, rules, features and test quality in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.operators import code as K
from codeweft.operators import extract as X
from codeweft.operators import testquality as Q
from codeweft.operators.rollups import histogram, project_measures
from codeweft.session import cut_lineage, load

R = lambda c, n=6: F.round(c, n)


def _files(spark, sf):
    return load(spark, sf, "files").select("file_id", "repo", "path", "short_path", F.col("programming_language").alias("language"), "is_test", "errors")


def _units(spark, sf, where: str = "true"):
    """Units of the files that ``where`` picks, written once, as the queries read them several times."""
    return cut_lineage(X.extract_units(load(spark, sf, "files").where(where)))


def c01_units(spark: SparkSession, sf: str) -> DataFrame:
    """Files, classes, functions, dependencies and parse errors of every file (C-01 to C-05, C-15)."""
    return X.extract_units(load(spark, sf, "files"))


def c01_function_metrics(spark, sf):
    """Complexity and Halstead volume of every extracted function, from source text to metric in one plan."""
    f = K.function_metrics(X.extract_units(load(spark, sf, "files")))
    return f.select("file_id", "owner", "name", "start_line", "ccn", R(F.col("h_volume")).alias("h_volume"), "loc", "lloc", "cloc", R(F.col("mi")).alias("mi"))


def c01_dependencies(spark, sf):
    """Distinct dependencies of each file from its source text, and how many files use each (C-13 on sources)."""
    d = X.extract_units(load(spark, sf, "files")).where("kind = 'dependency'").select("file_id", F.coalesce("namespace", "name").alias("name")).distinct()
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))


def c05_receiver_methods(spark, sf):
    """Methods of Go structs, by their receivers (C-05)."""
    u = X.extract_units(load(spark, sf, "files").where("programming_language = 'Golang'"))
    return u.where("kind = 'function' and owner is not null").groupBy("file_id", "owner").agg(F.count(F.lit(1)).alias("n_methods"), F.min("qualified").alias("first_method"))


def c11_functions(spark, sf):
    """Functions of each file, each once by its qualified, else its short name (C-04, C-11)."""
    f = X.extract_units(load(spark, sf, "files")).where("kind = 'function'").withColumn("key", F.coalesce("qualified", "name"))
    return X.distinct_units(f, ["key"], "start_line").select("file_id", "key", "name", "owner", "start_line")


def c13_file_dependencies(spark, sf):
    """Dependencies of each file: imports and parents, each once by namespace, class and owner (C-13, J-01)."""
    return X.extract_units(load(spark, sf, "files")).where("kind = 'dependency'").select("file_id", "namespace", F.col("name").alias("class_name"), F.col("owner").alias("from_name"), "role").distinct()


def d08_classes(spark, sf):
    """Classes of code: size, complexity, Halstead means, maintainability and LCOM4 (D-05, D-07, D-08, D-12)."""
    u = _units(spark, sf)
    c = K.class_metrics(u).select("file_id", F.col("name").alias("class_name"), "n_methods", "loc", "lloc", "cloc", "ccn", "h_vocabulary", "h_length", R(F.col("h_volume")).alias("h_volume"), R(F.col("mi")).alias("mi"), "depth")
    return c.join(K.class_cohesion(u, _files(spark, sf).select("file_id", "language")), ["file_id", "class_name"], "left")


def d20_depth_estimate(spark, sf):
    """Deepest nesting of decisions of each file's functions; functions and classes add none (D-19, D-20)."""
    u = X.extract_units(load(spark, sf, "files")).where("kind in ('function', 'class', 'file')")
    return u.groupBy("file_id").agg(F.max("depth").alias("depth"))


def e18_deep_functions(spark, sf, most: int = 3):
    """Functions whose decisions nest deeper than ``most`` (E-18 on code)."""
    return X.extract_units(load(spark, sf, "files")).where("kind = 'function'").where(F.col("depth") > most).select("file_id", "owner", "name", "start_line", "depth")


def e23_context_missing(spark, sf):
    """Go files with exported functions that use input, output or the network and take no context first (E-23)."""
    return K.context_missing(_units(spark, sf, "programming_language = 'Golang'"))


def e24_context_ignored(spark, sf):
    """Go files with functions that take a context and start one of their own (E-24)."""
    return K.context_ignored(X.extract_units(load(spark, sf, "files").where("programming_language = 'Golang'")))


def f02_code_dependencies(spark, sf):
    """Extracted dependencies with the class and file they resolve to, unresolved ones kept (F-02)."""
    return X.resolve_dependencies(X.extract_units(load(spark, sf, "files")), _files(spark, sf))


def b07_file_dependencies(spark, sf):
    """Files that each file's extracted dependencies lead to, and the relation inverted (B-07)."""
    return X.file_dependencies(X.extract_units(load(spark, sf, "files")), _files(spark, sf))


def b08_code_folders(spark, sf):
    """Dependencies between folders of files: edges, and files of the source folder (B-08)."""
    f = _files(spark, sf).select("file_id", "repo", F.regexp_replace("short_path", "/?[^/]*$", "").alias("folder"))
    deps = b07_file_dependencies(spark, sf).where("direction = 'efferent'")
    both = deps.join(f.select("file_id", "repo", F.col("folder").alias("src_folder")), "file_id").join(f.select(F.col("file_id").alias("other"), F.col("folder").alias("dst_folder")), "other")
    return both.groupBy("repo", "src_folder", "dst_folder").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("file_id").alias("n_files"))


def b13_ml_dataset(spark, sf):
    """The classifier's data set of 30 columns: a row a class, or a file without any; errored files left out (B-13)."""
    return K.feature_rows(_units(spark, sf), _files(spark, sf), ("class", "file"))


def l11_features(spark, sf):
    """Feature rows of classes, interfaces, functions and files, with the eight derived ratios (L-11, D-21)."""
    rows = K.derived_ratios(K.feature_rows(_units(spark, sf), _files(spark, sf)))
    return rows.select(*[R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def g03_code_measures(spark, sf):
    """Means of all measures by language, from source text (G-03, G-05)."""
    u = _units(spark, sf)
    lang = _files(spark, sf).select("file_id", F.coalesce("language", F.lit("unknown")).alias("scope"))
    used = u.where("kind = 'dependency'").groupBy("file_id").agg(F.count_distinct("namespace").alias("efferent"))
    c = K.class_metrics(u).join(lang, "file_id").join(used, "file_id", "left").withColumn("efferent", F.coalesce("efferent", F.lit(0))).withColumn("afferent", F.lit(0)).withColumn("instability", M.class_instability("efferent", "afferent"))
    c = c.withColumn("h_bugs", F.col("h_volume") / 3000)
    m = project_measures(K.function_metrics(u).join(lang, "file_id"), c)
    return m.select("scope", *[R(F.col(x).cast("double")).alias(x) for x in m.columns if x != "scope"])


def g21_lcom_histogram(spark, sf):
    """Classes of code by LCOM4: 1, below 2, below 4, and more; 0 is left out (G-21)."""
    c = K.class_cohesion(_units(spark, sf), _files(spark, sf).select("file_id", "language")).where("lcom4 > 0")
    return histogram(c, F.col("lcom4").cast("double"), [("1", 1.000001), ("<2", 2), ("<4", 4), (">=4", None)])


def n08_code_test_quality(spark, sf):
    """Test quality of each repo from source text: production classes, those that test files depend on, and isolation (N-08)."""
    u = _units(spark, sf)
    f = _files(spark, sf).select("file_id", F.col("repo").alias("scope"), F.coalesce("is_test", F.lit(False)).alias("is_test"))
    m = K.class_metrics(u).join(f, "file_id")
    classes = m.where("not is_test").groupBy("scope", F.col("name").alias("class_name")).agg(F.min("file_id").alias("file_id"), F.max("ccn").alias("ccn"), F.lit(0).alias("efferent"), F.lit(0).alias("afferent"))
    dependencies = u.where("kind = 'dependency'").join(f, "file_id").select("scope", "file_id", "is_test", F.col("name").alias("class_name"), "namespace", "owner").distinct()
    own = u.where("kind = 'class'").groupBy("file_id").agg(F.min("name").alias("first"))
    links = dependencies.where("not is_test").join(own, "file_id", "left").select("scope", F.coalesce("owner", "first").alias("src"), F.col("class_name").alias("dst")).where("src <> dst").distinct()
    known = classes.select("scope", F.col("class_name").alias("dst"))
    touched = cut_lineage(Q.touched_classes(classes, dependencies))
    tests = Q.test_files(f.where("is_test").select("scope", "file_id"), touched, Q.chain_depth(touched, cut_lineage(links.join(known, ["scope", "dst"], "left_semi"))))
    return Q.totals(classes, touched, tests)


QUERIES = {f.__name__: f for f in (
    c01_units, c01_function_metrics, c01_dependencies, c05_receiver_methods, c11_functions, c13_file_dependencies, d08_classes, d20_depth_estimate, e18_deep_functions, e23_context_missing, e24_context_ignored, f02_code_dependencies, b07_file_dependencies,
    b08_code_folders, b13_ml_dataset, l11_features, g03_code_measures, g21_lcom_histogram, n08_code_test_quality,
)}

SQL: dict[str, str] = {}
