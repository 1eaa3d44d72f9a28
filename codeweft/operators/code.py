"""Metrics of extracted code: functions, classes and files from the rows of ``extract_units``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.operators.graph import lcom4

#: Methods that begin or end an object's life, by language, and those of an unknown language (fixed values).
LIFECYCLE = {
    "PHP": ["__construct", "__destruct"], "Python": ["__init__", "__new__", "__del__"], "TypeScript": ["constructor"], "Java": ["finalize"], "C#": ["Finalize"], "Rust": ["new", "drop"], "Golang": [],
}
LIFECYCLE_ANY = ["__construct", "__destruct", "__init__", "__new__", "__del__", "constructor", "finalize", "Finalize"]
#: Languages whose constructor has the name of its class.
NAMED_AFTER_CLASS = ["Java", "C#", "PHP"]


def is_lifecycle(language, method, class_name) -> Column:
    """Whether a method is a constructor or destructor of its class in its language."""
    lang, name, cls = (F.col(x) if isinstance(x, str) else x for x in (language, method, class_name))
    listed = F.lit(False)
    for key, names in LIFECYCLE.items():
        if names:
            listed = listed | ((lang == key) & name.isin(names))
    known = F.coalesce(lang.isin(list(LIFECYCLE)), F.lit(False))
    by_class = (~known | lang.isin(NAMED_AFTER_CLASS)) & (name == cls)
    return F.coalesce(listed, F.lit(False)) | (~known & name.isin(LIFECYCLE_ANY)) | F.coalesce(by_class, F.lit(False))


def function_metrics(units: DataFrame) -> DataFrame:
    """Each function with ``ccn``, the Halstead measures and the maintainability index."""
    f = units.where("kind = 'function'").withColumn("ccn", M.cyclomatic())
    for name, value in M.halstead("n_distinct_operators", "n_distinct_operands", "n_operators", "n_operands").items():
        f = f.withColumn(name, value)
    for name, value in M.maintainability("loc", "lloc", "cloc", "ccn", "h_volume").items():
        f = f.withColumn(name, value)
    return f


def class_cohesion(units: DataFrame, languages: DataFrame) -> DataFrame:
    """``(file_id, class_name, lcom4)`` of classes of code.

    Methods are linked by attributes they share and by calls of each other; constructors, destructors and methods
    without a statement are left out.  ``languages(file_id, language)``.
    """
    m = units.where("kind = 'function' and owner is not null").select("file_id", "owner", "name", "lloc", "attributes", "calls").join(languages, "file_id")
    m = m.where(~is_lifecycle("language", "name", "owner") & (F.coalesce("lloc", F.lit(1)) > 0))
    # a call links both methods by the called one's name, which every method carries itself
    touched = F.concat(F.transform("attributes", lambda a: F.concat(F.lit("a:"), a)), F.transform("calls", lambda c: F.concat(F.lit("m:"), c)), F.array(F.concat(F.lit("m:"), F.col("name"))))
    touches = m.select(F.struct("file_id", F.col("owner").alias("class_name")).alias("c"), F.col("name").alias("method"), F.explode(F.array_distinct(touched)).alias("attribute"))
    touches = touches.select(F.to_json("c").alias("class_id"), "method", "attribute")
    groups = lcom4(touches).select(F.from_json("class_id", "file_id string, class_name string").alias("c"), "lcom4").select("c.*", "lcom4")
    classes = units.where("kind = 'class'").select("file_id", F.col("name").alias("class_name")).distinct()
    return classes.join(groups, ["file_id", "class_name"], "left").select("file_id", "class_name", F.coalesce("lcom4", F.lit(0)).cast("bigint").alias("lcom4"))


def class_metrics(units: DataFrame) -> DataFrame:
    """Each class with its functions' sums and means.

    ``ccn`` sums functions and the class's own decisions; Halstead measures are means over all functions, vocabulary and
    length rounded; ``loc`` is the larger of the class's own and its functions' lines, ``lloc`` its own if any, else theirs.
    """
    f = function_metrics(units).where("owner is not null").groupBy("file_id", F.col("owner").alias("name")).agg(
        F.count(F.lit(1)).alias("n_methods"), F.count_if("public").alias("n_public"), F.sum("ccn").alias("s_ccn"), F.sum("loc").alias("s_loc"), F.sum("lloc").alias("s_lloc"), F.sum("cloc").alias("s_cloc"), F.max("depth").alias("s_depth"),
        F.round(F.sum("h_vocabulary") / F.count(F.lit(1))).alias("h_vocabulary"), F.round(F.sum("h_length") / F.count(F.lit(1))).alias("h_length"), *[(F.sum(h) / F.count(F.lit(1))).alias(h) for h in ("h_volume", "h_difficulty", "h_effort", "h_time")],
        F.count_if(F.lower("name").rlike("^(get|is|has)")).alias("n_getters"), F.count_if(F.lower("name").rlike("^set")).alias("n_setters"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("calls")))).alias("m_calls"), F.array_distinct(F.flatten(F.collect_list("operators"))).alias("m_operators"),
        F.array_distinct(F.flatten(F.collect_list("attributes"))).alias("m_attributes"), F.sum("n_if").alias("m_if"), F.sum("n_elseif").alias("m_elseif"), F.sum("n_else").alias("m_else"), F.sum("n_case").alias("m_case"), F.sum("n_switch").alias("m_switch"), F.sum("n_loop").alias("m_loop"),
    )
    c = units.where("kind = 'class'").join(f, ["file_id", "name"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    c = c.withColumn("ccn", zero("s_ccn") + M.cyclomatic(baseline=0)).withColumn("loc", F.greatest("loc", zero("s_loc"))).withColumn("lloc", F.when(F.col("lloc") > 0, F.col("lloc")).otherwise(zero("s_lloc"))).withColumn("cloc", F.coalesce(F.nullif("cloc", F.lit(0)), zero("s_cloc")))
    for k in ("if", "elseif", "else", "case", "switch", "loop"):
        c = c.withColumn(f"n_{k}", zero(f"m_{k}") + zero(f"n_{k}"))
    c = c.withColumn("depth", F.greatest("depth", zero("s_depth"))).withColumn("n_methods", zero("n_methods")).withColumn("n_public", zero("n_public"))
    for name, value in M.maintainability("loc", "lloc", "cloc", "ccn", "h_volume").items():
        c = c.withColumn(name, value)
    return c.drop("s_ccn", "s_loc", "s_lloc", "s_cloc", "s_depth", "m_if", "m_elseif", "m_else", "m_case", "m_switch", "m_loop")


#: Columns of the classifier's data set, in its order (fixed values).
DATASET = (
    "stmt_name stmt_type file_path method_calls_raw uses_raw namespace_raw path_raw class_loc logical_loc comment_loc nb_comments nb_methods nb_extends nb_implements nb_traits count_if count_elseif count_else count_case count_switch count_loop "
    "nb_external_dependencies depth_estimate nb_method_calls nb_getters nb_setters nb_attributes nb_unique_operators programming_language cyclomatic_complexity"
).split()


def feature_rows(units: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("class", "interface", "function", "file")) -> DataFrame:
    """``(file_id, <DATASET>)``: a feature row of each class, interface, function or file of code.

    ``files(file_id, path, short_path, language, errors)``; errored files give no rows.  A file has a row of its own only where it
    has no class.  Lists are joined by ';'.
    """
    f = files.where("errors is null or size(errors) = 0").select("file_id", F.coalesce(F.nullif("short_path", F.lit("")), "path").alias("path_raw"), F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("programming_language"))
    deps = units.where("kind = 'dependency'").groupBy("file_id").agg(F.array_sort(F.collect_set("namespace")).alias("uses"))
    owned = units.where("kind = 'dependency' and owner is not null").groupBy("file_id", F.col("owner").alias("name")).agg(F.count_distinct("namespace").alias("n_own"))
    wide = ["file_id", "name", "qualified", "namespace", "loc", "lloc", "cloc", "n_if", "n_elseif", "n_else", "n_case", "n_switch", "n_loop", "depth", "parents", "ccn", "n_methods", "n_getters", "n_setters", "m_calls", "m_operators", "m_attributes"]
    none = F.array().cast("array<string>")
    rows = []
    if "class" in kinds:
        rows.append(class_metrics(units).select(F.lit("class").alias("stmt_type"), *wide))
    for kind in ("interface", "function", "file"):
        if kind in kinds:
            own = units.where(F.col("kind") == kind).withColumn("ccn", M.cyclomatic(baseline=1 if kind == "function" else 0))
            for c in ("n_methods", "n_getters", "n_setters"):
                own = own.withColumn(c, F.lit(0).cast("bigint"))
            own = own.withColumn("m_calls", F.array_sort(F.array_distinct("calls"))).withColumn("m_operators", F.col("operators")).withColumn("m_attributes", F.col("attributes"))
            if kind == "file":
                own = own.join(units.where("kind = 'class'").select("file_id").distinct(), "file_id", "left_anti")
            rows.append(own.select(F.lit(kind).alias("stmt_type"), *wide))
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    u = u.join(f, "file_id").join(deps, "file_id", "left").join(owned, ["file_id", "name"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    size = lambda c: F.size(F.coalesce(c, none))
    name = F.when(F.col("stmt_type") == "file", F.element_at(F.split("path_raw", "/"), -1)).otherwise(F.coalesce("qualified", "name"))
    values = {
        "stmt_name": name, "stmt_type": F.col("stmt_type"), "file_path": F.col("path_raw"), "method_calls_raw": F.array_join(F.coalesce("m_calls", none), ";"), "uses_raw": F.array_join(F.coalesce("uses", none), ";"), "namespace_raw": F.coalesce("namespace", F.lit("")),
        "path_raw": F.col("path_raw"), "class_loc": zero("loc"), "logical_loc": zero("lloc"), "comment_loc": zero("cloc"), "nb_comments": zero("cloc"), "nb_methods": zero("n_methods"), "nb_extends": size("parents"), "nb_implements": F.lit(0), "nb_traits": F.lit(0),
        "count_if": zero("n_if"), "count_elseif": zero("n_elseif"), "count_else": zero("n_else"), "count_case": zero("n_case"), "count_switch": zero("n_switch"), "count_loop": zero("n_loop"), "nb_external_dependencies": size("uses") + zero("n_own"),
        "depth_estimate": zero("depth"), "nb_method_calls": size("m_calls"), "nb_getters": zero("n_getters"), "nb_setters": zero("n_setters"), "nb_attributes": size("m_attributes"), "nb_unique_operators": size("m_operators"),
        "programming_language": F.col("programming_language"), "cyclomatic_complexity": zero("ccn"),
    }
    return u.select("file_id", *[values[c].alias(c) for c in DATASET])


def derived_ratios(features: DataFrame) -> DataFrame:
    """The eight ratios of a feature row: denominators of 0 are 1, values are clamped to [0, 100]."""
    r = M.ratio
    return features.select(
        "*", r("nb_getters", "nb_methods").alias("getter_ratio"), r("nb_setters", "nb_methods").alias("setter_ratio"), r("class_loc", "nb_methods").alias("loc_per_method"), r("cyclomatic_complexity", "nb_methods").alias("ccn_per_method"),
        r("nb_attributes", "nb_methods").alias("attributes_per_method"), r("comment_loc", "class_loc").alias("comment_ratio"), r("nb_method_calls", "class_loc").alias("call_density"), r("nb_external_dependencies", "nb_methods").alias("dependencies_per_method"),
    )


#: What a Go package is for, by the beginning of its import path (fixed values): input, output and network.
IO_PACKAGES = r"^(?:net(?:/|$)|io|os|database|syscall|bufio|crypto/tls)"


def context_missing(units: DataFrame) -> DataFrame:
    """``(file_id, flagged, checked)``: exported Go functions of files that use input, output or the network, and those of them
    whose first parameter is no context (only files with any)."""
    io = units.where(F.lower("namespace").rlike(IO_PACKAGES) & (F.col("kind") == "dependency")).select("file_id", F.col("name").alias("package")).distinct()
    f = units.where("kind = 'function' and name rlike '^[A-Z]'").select("file_id", "name", "parameters", "operands")
    # a function uses a package where one of its member chains starts with it
    used = f.join(io, "file_id").where(F.exists("operands", lambda o: F.startswith(o, F.concat("package", F.lit(".")))))
    used = used.select("file_id", "name", "parameters").distinct()
    first = F.lower(F.coalesce(F.get("parameters", F.lit(0)), F.lit("")))
    return used.groupBy("file_id").agg(F.count_if(~F.regexp_replace(first, " ", "").contains("context.context")).alias("flagged"), F.count(F.lit(1)).alias("checked")).where("flagged > 0")


def context_ignored(units: DataFrame) -> DataFrame:
    """``(file_id, flagged)``: Go functions that take a ``ctx`` and yet start a context of their own."""
    f = units.where("kind = 'function'").where(F.exists("parameters", lambda p: F.lower(F.split(p, " ")[0]) == "ctx"))
    own = F.exists("operands", lambda o: o.isin("context.Background", "context.TODO"))
    return f.groupBy("file_id").agg(F.count_if(own).alias("flagged")).where("flagged > 0")
