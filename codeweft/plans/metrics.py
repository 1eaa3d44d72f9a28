"""Scalar metrics (D) over units, classes and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.functions.text import identifier_words
from codeweft.operators.code import LIFECYCLE, LIFECYCLE_ANY, is_lifecycle
from codeweft.plans.adapters import CCN, MEASURED, UNITS, measured, units
from codeweft.session import load

R = lambda c, n=6: F.round(c, n)


def d01_cyclomatic(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of each function, without and with the function's baseline (D-01, D-02)."""
    return units(spark, sf).select("unit_id", M.cyclomatic(baseline=0).alias("decisions"), M.cyclomatic().alias("ccn"))


def d03_file_ccn(spark, sf):
    """File complexity: classes plus functions outside classes (visibility P stands for outside)."""
    u = units(spark, sf).withColumn("ccn", M.cyclomatic())
    return u.groupBy("file_id").agg(F.sum(F.when(F.col("visibility") != "P", F.col("ccn"))).alias("class_ccn"), F.sum(F.when(F.col("visibility") == "P", F.col("ccn"))).alias("function_ccn"), F.sum("ccn").alias("ccn"))


def _halstead(df):
    h = M.halstead("n_distinct_operators", "n_distinct_operands", "n_operators", "n_operands")
    return df.select("*", *[e.alias(k) for k, e in h.items()])


def d04_halstead(spark, sf):
    """Halstead measures of each function."""
    h = _halstead(units(spark, sf))
    return h.select("unit_id", *[R(F.col(c)).alias(c) for c in ("h_vocabulary", "h_length", "h_est_length", "h_volume", "h_difficulty", "h_effort", "h_time", "h_bugs")])


def d05_class_halstead(spark, sf):
    """Class means over all its functions; vocabulary and length rounded half away from zero."""
    h = _halstead(units(spark, sf))
    return h.groupBy("class_id").agg(F.round(F.avg("h_vocabulary"), 0).alias("h_vocabulary"), F.round(F.avg("h_length"), 0).alias("h_length"), R(F.avg("h_volume")).alias("h_volume"), R(F.avg("h_difficulty")).alias("h_difficulty"))


def d06_file_halstead(spark, sf):
    """File means over classes that have code, and over functions where the file has no class."""
    h = _halstead(units(spark, sf)).where("h_vocabulary <> 0 or h_length <> 0")
    classes = h.groupBy("file_id", "class_id").agg(F.avg("h_volume").alias("v"), F.avg("h_length").alias("n"))
    return classes.groupBy("file_id").agg(R(F.avg("v")).alias("h_volume"), R(F.avg("n")).alias("h_length"), F.count(F.lit(1)).alias("n_scopes"))


def d07_maintainability(spark, sf):
    """Maintainability index, without comments, and comment weight of each function."""
    h = _halstead(units(spark, sf)).withColumn("ccn", M.cyclomatic())
    m = M.maintainability("loc", "lloc", "cloc", "ccn", "h_volume")
    return h.select("unit_id", *[R(e).alias(k) for k, e in m.items()])


def _methods(spark, sf):
    """Measured functions with the class and method of their name and the language of their file."""
    lang = load(spark, sf, "files").select("file_id", F.col("programming_language").alias("language"))
    f = measured(spark, sf).where("kind = 'function' and item_name is not null").join(lang, "file_id", "left")
    return f.withColumn("class_name", F.split("item_name", r"\.")[0]).withColumn("method", F.element_at(F.split("item_name", r"\."), -1))


def d09_lifecycle(spark, sf):
    """Methods that count for cohesion: no constructor or destructor of their language, and not empty (D-09, D-10)."""
    return _methods(spark, sf).where(~is_lifecycle("language", "method", "class_name") & (F.coalesce("loc", F.lit(1)) > 0)).select("item_id", "class_name", "method")


def d11_lcom_hs(spark, sf):
    """LCOM-HS of each class, with suppliers as attributes: (m - sum(mu) / a) / (m - 1), clamped."""
    touch = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("class_id"), F.col("o_orderkey").alias("m"), (F.col("l_suppkey") % 7).alias("a")).distinct()
    g = touch.groupBy("class_id").agg(F.count_distinct("m").alias("m"), F.count_distinct("a").alias("a"), F.count(F.lit(1)).alias("mu"))
    raw = (F.col("m") - F.col("mu") / F.col("a")) / F.when(F.col("m") > 1, F.col("m") - 1)
    return g.select("class_id", R(F.when(F.col("m") > 1, M.clamp01(raw)).otherwise(0.0)).alias("lcom_hs"))


def d12_class_loc(spark, sf):
    """Class lines consolidated: the larger of the class's own lines and those of its functions (D-12)."""
    own = measured(spark, sf).where("kind = 'class' and item_name is not null").groupBy("file_id", F.col("item_name").alias("class_name")).agg(F.max("loc").alias("own"))
    sums = _methods(spark, sf).groupBy("file_id", "class_name").agg(F.sum("loc").alias("total"))
    return own.join(sums, ["file_id", "class_name"], "left").select("file_id", "class_name", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("total", F.lit(0))).alias("loc"))


def d13_risk(spark, sf):
    """Risk score of each file from its complexity and its commits."""
    return _file_risk(spark, sf).select("file_id", R(F.col("risk")).alias("risk"))


def _file_risk(spark, sf):
    commits = load(spark, sf, "commits").where("file_id is not null").groupBy("file_id").agg(F.count_distinct("repo", "hash").alias("n_commits"))
    files = measured(spark, sf).where("kind = 'file'").groupBy("file_id").agg(F.max("cyclomatic_complexity").alias("ccn"))
    both = files.join(commits, "file_id")
    top = both.agg(F.max("n_commits").alias("max_commits"), F.max("ccn").alias("max_ccn"))  # one row
    return both.crossJoin(F.broadcast(top)).withColumn("risk", M.risk("max_commits", "n_commits", "max_ccn", F.coalesce("ccn", F.lit(0))))


def d14_file_risk(spark, sf):
    """File risk: its complexity's risk plus the risk of each of its classes' maintainability, bounds over files with commits."""
    commits = load(spark, sf, "commits").where("file_id is not null").groupBy("file_id").agg(F.count_distinct("repo", "hash").alias("n_commits"))
    m = measured(spark, sf)
    files = m.where("kind = 'file'").groupBy("file_id").agg(F.max("cyclomatic_complexity").alias("ccn")).join(commits, "file_id")
    classes = m.where("kind = 'class' and maintainability_index is not null").select("file_id", (F.lit(128) - F.col("maintainability_index")).cast("int").alias("bad")).join(files.select("file_id", "n_commits"), "file_id")
    tops = files.agg(F.max("n_commits").alias("max_commits"), F.max("ccn").alias("max_ccn")).crossJoin(F.broadcast(classes.agg(F.max("bad").alias("max_bad"))))
    own = files.crossJoin(F.broadcast(tops)).select("file_id", M.risk("max_commits", "n_commits", "max_ccn", F.coalesce("ccn", F.lit(0))).alias("risk"))
    by_class = classes.crossJoin(F.broadcast(tops)).select("file_id", M.risk("max_commits", "n_commits", "max_bad", "bad").alias("risk"))
    return own.unionByName(by_class).groupBy("file_id").agg(R(F.sum("risk"), 5).alias("risk"), F.count(F.lit(1)).alias("n_parts"))


def d15_instability(spark, sf):
    """Instability of classes (Ce over all) and of files (Ca over all) (D-15, D-16)."""
    m = measured(spark, sf)
    return m.where("kind in ('class', 'file')").select("item_id", "kind", R(M.class_instability("efferent", "afferent")).alias("class_instability"), R(M.file_instability("efferent", "afferent")).alias("file_instability"))


def d17_isolation(spark, sf):
    """Isolation score and label from fan-out and depth (D-17), and orphan weight (D-18)."""
    m = measured(spark, sf).where("kind = 'class'").withColumn("score", M.isolation_score("efferent", F.col("afferent") % 4))
    return m.select("item_id", "score", M.isolation_label("score").alias("label"), M.orphan_weight(F.coalesce("cyclomatic_complexity", F.lit(0)), "efferent", "afferent").alias("weight"))


def d19_nesting(spark, sf):
    """Deepest overlap of the intervals [order date, last ship date] of each customer, ends before starts."""
    o = load(spark, sf, "orders").join(load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("stop")), F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.select("o_custkey", F.col("o_orderdate").alias("start"), F.greatest("stop", "o_orderdate").alias("stop"))
    events = o.select("o_custkey", F.col("start").alias("at"), F.lit(1).alias("delta")).unionAll(o.select("o_custkey", "stop", F.lit(-1)))
    w = Window.partitionBy("o_custkey").orderBy("at", "delta").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum("delta").over(w)).groupBy("o_custkey").agg(F.max("depth").alias("max_depth"))


def d21_ratios(spark, sf):
    """Derived ratios of the classifier's features, denominators of 0 taken as 1, clamped."""
    s = load(spark, sf, "class_samples")
    return s.select("sample_id", R(M.ratio("class_loc", "nb_methods")).alias("loc_per_method"), R(M.ratio("cyclomatic_complexity", "nb_methods")).alias("ccn_per_method"))


def d22_accessors(spark, sf):
    """Getters and setters of each class by the prefix of the method's name, whatever the case."""
    name = F.lower(F.element_at(F.split("item_name", r"\."), -1))
    f = measured(spark, sf).where("kind = 'function' and item_name is not null").select("file_id", F.split("item_name", r"\.")[0].alias("class_name"), name.alias("name"))
    return f.groupBy("file_id", "class_name").agg(F.count_if(F.col("name").rlike("^(get|is|has)")).alias("getters"), F.count_if(F.col("name").rlike("^set")).alias("setters"))


def d23_bands(spark, sf):
    """Colour band, short number and short name of measured items (D-23 to D-25)."""
    m = measured(spark, sf)
    return m.select("item_id", M.mi_band("maintainability_index").alias("band"), M.short_number(F.col("loc") * 100).alias("loc_text"), M.short_name("item_name").alias("short_name"))


def l07_identifier_words(spark, sf):
    """Words of each distinct item name."""
    return measured(spark, sf).where("item_name is not null").select("item_name").distinct().select("item_name", F.array_join(identifier_words("item_name"), " ").alias("words"))


_H = """
    h AS (SELECT *, CAST(n_distinct_operators + n_distinct_operands AS DOUBLE) AS h_vocabulary, CAST(n_operators + n_operands AS DOUBLE) AS h_length,
      n_distinct_operators * log2(n_distinct_operators) + n_distinct_operands * log2(n_distinct_operands) AS h_est_length,
      (n_operators + n_operands) * log2(n_distinct_operators + n_distinct_operands) AS h_volume,
      n_distinct_operators / 2.0::DOUBLE * (n_operands / n_distinct_operands::DOUBLE) AS h_difficulty FROM units)"""
_FR = """
    k AS (SELECT file_id, count(DISTINCT repo || ' ' || hash) AS n_commits FROM commits WHERE file_id IS NOT NULL GROUP BY file_id),
    f AS (SELECT m.file_id, n_commits, max(cyclomatic_complexity) AS ccn FROM metrics m JOIN k ON k.file_id = m.file_id WHERE kind = 'file' GROUP BY m.file_id, n_commits)"""
_RISK = "greatest(0.0, least(1.0, 1 - sqrt(pow(CASE WHEN {tc} > 0 THEN greatest(0.0, least(1.0, ({tc} - {c}) / {tc}::DOUBLE)) ELSE 0 END, 2) + pow(CASE WHEN {tv} > 0 THEN greatest(0.0, least(1.0, ({tv} - {v}) / {tv}::DOUBLE)) ELSE 0 END, 2))))"

QUERIES = {f.__name__: f for f in (
    d01_cyclomatic, d03_file_ccn, d04_halstead, d05_class_halstead, d06_file_halstead, d07_maintainability, d09_lifecycle, d11_lcom_hs, d12_class_loc, d13_risk, d14_file_risk, d15_instability,
    d17_isolation, d19_nesting, d21_ratios, d22_accessors, d23_bands, l07_identifier_words,
)}

SQL = {
    "d01_cyclomatic": f"WITH {UNITS} SELECT unit_id, {CCN} - 1 AS decisions, {CCN} AS ccn FROM units",
    "d03_file_ccn": f"WITH {UNITS} SELECT file_id, CAST(sum({CCN}) FILTER (visibility <> 'P') AS BIGINT) AS class_ccn, CAST(sum({CCN}) FILTER (visibility = 'P') AS BIGINT) AS function_ccn, CAST(sum({CCN}) AS BIGINT) AS ccn FROM units GROUP BY file_id",
    "d04_halstead": f"WITH {UNITS}, {_H} SELECT unit_id, h_vocabulary, h_length, round(h_est_length, 6) AS h_est_length, round(h_volume, 6) AS h_volume, round(h_difficulty, 6) AS h_difficulty, round(h_difficulty * h_volume, 6) AS h_effort, round(h_difficulty * h_volume / 18, 6) AS h_time, round(CASE WHEN h_volume > 0 THEN h_volume / 3000 END, 6) AS h_bugs FROM h",
    "d05_class_halstead": f"WITH {UNITS}, {_H} SELECT class_id, round(avg(h_vocabulary), 0) AS h_vocabulary, round(avg(h_length), 0) AS h_length, round(avg(h_volume), 6) AS h_volume, round(avg(h_difficulty), 6) AS h_difficulty FROM h GROUP BY class_id",
    "d06_file_halstead": f"WITH {UNITS}, {_H} SELECT file_id, round(avg(v), 6) AS h_volume, round(avg(n), 6) AS h_length, count(*) AS n_scopes FROM (SELECT file_id, class_id, avg(h_volume) AS v, avg(h_length) AS n FROM h WHERE h_vocabulary <> 0 OR h_length <> 0 GROUP BY file_id, class_id) GROUP BY file_id",
    "d07_maintainability": f"""WITH {UNITS}, {_H}, w AS (SELECT unit_id, greatest(0.0, (171 - 5.2 * ln(CASE WHEN h_volume > 0 THEN h_volume END) - 0.23 * {CCN} - 16.2 * ln(CASE WHEN lloc > 0 THEN lloc END)) * 100 / 171) AS woc,
        CASE WHEN loc > 0 THEN 50 * sin(sqrt(2.4 * cloc / loc)) ELSE 0.0 END AS cw, h_volume FROM h)
        SELECT unit_id, round(CASE WHEN h_volume > 0 THEN coalesce(woc, 0.0) + cw END, 6) AS mi, round(CASE WHEN h_volume > 0 THEN coalesce(woc, 0.0) END, 6) AS mi_woc, round(CASE WHEN h_volume > 0 THEN cw END, 6) AS comment_weight FROM w""",
    "d09_lifecycle": f"""WITH {MEASURED}, f AS (SELECT m.*, programming_language AS lang, split_part(item_name, '.', 1) AS class_name, split_part(item_name, '.', -1) AS method FROM measured m LEFT JOIN files f ON f.file_id = m.file_id WHERE kind = 'function' AND item_name IS NOT NULL)
        SELECT item_id, class_name, method FROM f WHERE coalesce(loc, 1) > 0 AND NOT (CASE WHEN lang IN ({', '.join(f"'{x}'" for x in LIFECYCLE)}) THEN {' OR '.join(f"(lang = '{k}' AND method IN ({', '.join(repr(x) for x in v)}))" for k, v in LIFECYCLE.items() if v)} OR (lang IN ('Java', 'C#', 'PHP') AND method = class_name)
            ELSE method IN ({', '.join(repr(x) for x in LIFECYCLE_ANY)}) OR method = class_name END)""",
    "d11_lcom_hs": """WITH t AS (SELECT DISTINCT o_custkey AS class_id, o_orderkey AS m, l_suppkey % 7 AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        g AS (SELECT class_id, count(DISTINCT m) AS m, count(DISTINCT a) AS a, count(*) AS mu FROM t GROUP BY class_id)
        SELECT class_id, round(CASE WHEN m > 1 THEN greatest(0.0, least(1.0, (m - mu / a::DOUBLE) / (m - 1))) ELSE 0.0 END, 6) AS lcom_hs FROM g""",
    "d12_class_loc": """WITH o AS (SELECT file_id, item_name AS class_name, max(loc) AS own FROM metrics WHERE kind = 'class' AND item_name IS NOT NULL GROUP BY 1, 2), t AS (SELECT file_id, split_part(item_name, '.', 1) AS class_name, sum(loc) AS total FROM metrics WHERE kind = 'function' AND item_name IS NOT NULL GROUP BY 1, 2)
        SELECT o.file_id, o.class_name, CAST(greatest(coalesce(own, 0), coalesce(total, 0)) AS BIGINT) AS loc FROM o LEFT JOIN t ON t.file_id = o.file_id AND t.class_name = o.class_name""",
    "d13_risk": f"WITH {_FR}, t AS (SELECT max(n_commits) AS tc, max(ccn) AS tv FROM f) SELECT file_id, round({_RISK.format(tc='tc', c='n_commits', tv='tv', v='coalesce(ccn, 0)')}, 6) AS risk FROM f, t",
    "d14_file_risk": f"""WITH {_FR}, {MEASURED}, c AS (SELECT m.file_id, n_commits, CAST(trunc(128 - maintainability_index) AS INTEGER) AS bad FROM measured m JOIN f ON f.file_id = m.file_id WHERE kind = 'class' AND maintainability_index IS NOT NULL),
        t AS (SELECT max(n_commits) AS tc, max(ccn) AS tv, (SELECT max(bad) FROM c) AS tb FROM f)
        SELECT file_id, round(sum(risk), 5) AS risk, count(*) AS n_parts FROM (SELECT file_id, {_RISK.format(tc='tc', c='n_commits', tv='tv', v='coalesce(ccn, 0)')} AS risk FROM f, t
            UNION ALL SELECT file_id, {_RISK.format(tc='tc', c='n_commits', tv='tb', v='bad')} FROM c, t) GROUP BY file_id""",
    "d15_instability": "SELECT item_id, kind, round(CASE WHEN efferent > 0 AND afferent > 0 THEN efferent / (efferent + afferent)::DOUBLE ELSE 0.0 END, 6) AS class_instability, round(CASE WHEN efferent + afferent > 0 THEN afferent / (efferent + afferent)::DOUBLE ELSE 0.0 END, 6) AS file_instability FROM metrics WHERE kind IN ('class', 'file')",
    "d17_isolation": "WITH s AS (SELECT *, greatest(0, least(100, 100 - 10 * efferent - 5 * (afferent % 4))) AS score FROM metrics WHERE kind = 'class') SELECT item_id, score, CASE WHEN score >= 80 THEN 'Isolated' WHEN score >= 50 THEN 'Semi-isolated' ELSE 'Coupled' END AS label, greatest(1, coalesce(cyclomatic_complexity, 0) * (1 + efferent + afferent)) AS weight FROM s",
    "d19_nesting": """WITH o AS (SELECT o_custkey, o_orderdate AS a, greatest(z, o_orderdate) AS z FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS z FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
        e AS (SELECT o_custkey, a AS tp, 1 AS d FROM o UNION ALL SELECT o_custkey, z, -1 FROM o)
        SELECT o_custkey, CAST(max(depth) AS BIGINT) AS max_depth FROM (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY tp, d ROWS UNBOUNDED PRECEDING) AS depth FROM e) GROUP BY o_custkey""",
    "d21_ratios": "SELECT sample_id, round(least(100.0, greatest(0.0, class_loc / CASE WHEN nb_methods = 0 THEN 1.0::DOUBLE ELSE nb_methods END)), 6) AS loc_per_method, round(least(100.0, greatest(0.0, cyclomatic_complexity / CASE WHEN nb_methods = 0 THEN 1.0::DOUBLE ELSE nb_methods END)), 6) AS ccn_per_method FROM class_samples",
    "d22_accessors": "SELECT file_id, split_part(item_name, '.', 1) AS class_name, count(*) FILTER (regexp_matches(lower(split_part(item_name, '.', -1)), '^(get|is|has)')) AS getters, count(*) FILTER (regexp_matches(lower(split_part(item_name, '.', -1)), '^set')) AS setters FROM metrics WHERE kind = 'function' AND item_name IS NOT NULL GROUP BY 1, 2",
    "d23_bands": f"WITH {MEASURED} SELECT item_id, CASE WHEN floor(maintainability_index) < 65 THEN 'red' WHEN floor(maintainability_index) < 85 THEN 'yellow' ELSE 'green' END AS band, CASE WHEN loc * 100 >= 1000000 THEN CAST(loc * 100 // 1000000 AS VARCHAR) || ' M' WHEN loc * 100 >= 1000 THEN CAST(loc * 100 // 1000 AS VARCHAR) || ' K' ELSE CAST(loc * 100 AS VARCHAR) END AS loc_text, split_part(item_name, '.', -1) AS short_name FROM measured",
    "l07_identifier_words": r"SELECT DISTINCT item_name, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(item_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM metrics WHERE item_name IS NOT NULL",
}
