"""Lint (E), review (M), test quality and text queries (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.functions import text as X
from codeweft.operators import lint as L
from codeweft.operators import review as V
from codeweft.operators import testquality as Q
from codeweft.operators import text as T
from codeweft.plans.adapters import MEASURED, measured
from codeweft.session import cut_lineage, load

#: Limits of the registered lint run.
LIMITS = {
    "afferent_coupling": 6, "efferent_coupling": 8, "maintainability": 80, "no_circular_dependencies": 0.8, "max_responsibilities": 3, "no_god_class": 500, "max_loc": 150, "max_lloc": 120, "max_loc_by_method": 30, "max_lloc_by_method": 28,
    "max_methods_per_class": 8, "max_public_methods": 6, "max_switch_cases": 25, "max_nested_blocks": 30, "max_parameters_per_method": 3, "cyclomatic_complexity": 20, "max_nesting_depth": 4, "max_file_size": 300,
}


#: Languages in the order of their codes.
LANGUAGE_CODES = ["C#", "Golang", "Java", "PHP", "Python", "Rust", "TypeScript"]


def _scopes(spark, sf) -> dict[str, DataFrame]:
    m = measured(spark, sf)
    mi, ccn = F.col("maintainability_index").alias("mi"), F.col("cyclomatic_complexity").alias("ccn")
    subject = F.col("item_id").cast("string").alias("subject")
    common = ["file_id", subject, ccn, "loc", (F.col("loc") - 5).alias("lloc"), mi, "afferent", "efferent", "instability", (F.col("afferent") % 5).alias("lcom4"), F.col("efferent").alias("n_methods"), (F.col("efferent") - 1).alias("n_public"), (F.col("afferent") % 6).alias("n_parameters"), (F.col("cyclomatic_complexity") % 7).alias("depth")]
    return {k: m.where(F.col("kind") == k).select(*common) for k in ("file", "class", "function")}


def e30_lint(spark: SparkSession, sf: str) -> DataFrame:
    """All enabled threshold rules over files, classes and functions (E-02 to E-19, E-29, E-30)."""
    return L.evaluate(_scopes(spark, sf), L.threshold_rules(LIMITS))


def e30_severities(spark, sf):
    return L.severity_counts(e30_lint(spark, sf))


def b15_lint_report(spark, sf):
    """Violations grouped by file, messages sorted, as the console prints them."""
    return e30_lint(spark, sf).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "rule", "subject"))), "; ").alias("messages"))


def e20_files_per_package(spark, sf, most: int = 5):
    """Packages with more files than ``most``, tests and doc files aside."""
    f = load(spark, sf, "files").where(~F.col("short_path").rlike(r"_test\.go$|(^|/)doc\.go$"))
    folder = F.regexp_replace("short_path", "/?[^/]*$", "")
    return f.groupBy("repo", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def e21_package_in_name(spark, sf):
    """Exported functions whose name holds their package's name."""
    f = measured(spark, sf).where("kind = 'function' and item_name is not null")
    name, package = F.element_at(F.split("item_name", r"\."), -1), F.lower(F.element_at(F.split("path", "/"), -2))
    return f.where((F.length(package) > 2) & F.lower(name).contains(package)).select("item_id", name.alias("name"), package.alias("package"))


#: A bounded for loop with its header in parentheses and the block up to the first closing brace, and an append, as the
#: reference has them; white space is written out, as engines differ in what it holds.
_BOUNDED_FOR = r"for[ \t\r\n\f]*\([^)]*;[ \t\r\n\f]*[a-zA-Z0-9_]+[ \t\r\n\f]*<[ \t\r\n\f]*(len[ \t\r\n\f]*\([^)]*\)|[a-zA-Z0-9_]+);[^)]*\)[ \t\r\n\f]*\{[^}]*\}"
_APPEND = r"append[ \t\r\n\f]*\([ \t\r\n\f]*[a-zA-Z0-9_]+[ \t\r\n\f]*,"


def e22_slice_prealloc(spark, sf):
    """Go files with the number of bounded for blocks that append to a slice (E-22: first the block, then the append inside it)."""
    return L.slice_prealloc(load(spark, sf, "files").where("programming_language = 'Golang'"), _BOUNDED_FOR, _APPEND)


#: Roles (kind:category:layer) that the registered role queries give the packages by the last part of their name, with the layer by
#: the part before it (parameters of the query; a classifier's labels take their place).
ROLE_OF = {"ledger": "component:domain:rule", "token": "component:app:service", "parcel": "component:interface:controller", "quota": "infrastructure:storage:database", "beacon": "component:data_access:repository", "window": "component:view:interface", "core": "component:domain:entity"}


def package_roles(spark, sf):
    """``(node, role)`` of every package, by ``ROLE_OF``; others are components of the domain's values."""
    e = load(spark, sf, "edges").where("src is not null and dst is not null")
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct()
    role = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_OF.items() for x in kv]), F.element_at(F.split("node", r"\."), -1))
    return nodes.select("node", F.coalesce(role, F.lit("component:domain:value_object")).alias("role"))


def e35_role_violations(spark, sf):
    """Package relations that one of the four rules between roles forbids, with their number (E-35)."""
    e = load(spark, sf, "edges").where("src is not null and dst is not null").select("repo", "src", "dst")
    return L.forbidden_roles(e, package_roles(spark, sf)).groupBy("from_role", "to_role").agg(F.count(F.lit(1)).alias("n"))


def e36_risk_items(spark, sf):
    """Risk detectors over files (E-36 to E-39)."""
    lang = load(spark, sf, "files").select("file_id", F.col("programming_language").alias("language"))
    m = measured(spark, sf)
    f = m.groupBy("file_id").agg(F.count_if(F.col("kind") == "class").alias("n_classes"), F.count_if(F.col("kind") == "function").alias("n_methods"), F.sum(F.when(F.col("kind") == "file", F.col("h_volume") / 3000)).alias("bugs"), F.max("afferent").alias("lcom4"), F.max("efferent").alias("efferent")).join(lang, "file_id")
    return L.risk_items(f.withColumn("lcom4", F.col("lcom4") - 4))


def e40_suggestions(spark, sf, risk: float = 0.7, commits: int = 3, index: float = 65, complexity: int = 50, enough: int = 10):
    """Hotspots, hard classes and complex busy files, each once, file by file until ``enough`` are found (E-40)."""
    m = measured(spark, sf)
    counts = load(spark, sf, "commits").where("file_id is not null").groupBy("file_id").agg(F.count_distinct("repo", "hash").alias("n"))
    f = m.where("kind = 'file'").groupBy("file_id").agg(F.max("risk_score").alias("risk"), F.max("cyclomatic_complexity").alias("ccn")).join(counts, "file_id")
    hard = m.where((F.col("kind") == "class") & (F.col("maintainability_index") < index)).select("file_id", F.coalesce("item_name", F.lit("")).alias("location"))
    return V.suggestions(f, hard, risk, commits, complexity, enough)


def _revisions(spark, sf):
    """Base: the metrics as they are; head: values shifted for some items, some items gone, some new."""
    m = measured(spark, sf).where("kind in ('function', 'class')").select(F.col("item_id").cast("string").alias("subject"), F.col("cyclomatic_complexity").alias("ccn"), F.col("maintainability_index").alias("mi"), "efferent", F.col("item_id").alias("i"))
    base = m.where("i % 11 <> 0")
    head = m.where("i % 13 <> 0").select("subject", (F.col("ccn") + F.when(F.col("i") % 3 == 0, 9).when(F.col("i") % 3 == 1, -2).otherwise(0)).alias("ccn"), (F.col("mi") + F.when(F.col("i") % 5 == 0, -60).when(F.col("i") % 5 == 1, 20).otherwise(0)).alias("mi"), (F.col("efferent") + F.when(F.col("i") % 7 == 0, 3).otherwise(0)).alias("efferent"))
    return head, base


def m03_function_findings(spark, sf):
    """New complex functions, regressions and improvements (M-03 to M-05)."""
    head, base = _revisions(spark, sf)
    return V.function_findings(head, base)


def m06_index_findings(spark, sf):
    """Maintainability and coupling findings (M-06 to M-08)."""
    head, base = _revisions(spark, sf)
    return V.index_findings(head, base)


def m11_gate(spark, sf):
    """The quality gate at each level over all findings, with their summary (M-11, G-26)."""
    found = m03_function_findings(spark, sf).select("kind", "severity").unionByName(m06_index_findings(spark, sf).select("kind", "severity"))
    out = None
    for level in ("high", "medium", "any", "never"):
        row = V.gate(found, level).select(F.lit(level).alias("level"), "failed", "n")
        out = row if out is None else out.unionByName(row)
    return out


def m02_file_delta(spark, sf):
    """Changed, added and deleted orders between the two halves of the year by customer and status, with negligible ones flagged (M-02, F-06, F-08, M-10)."""
    o = load(spark, sf, "orders").groupBy(F.concat_ws("/", "o_custkey", "o_orderstatus").alias("path"), (F.month("o_orderdate") > 6).alias("late")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("size"), F.max("o_orderkey").alias("checksum"))
    changes = V.negligible(V.file_changes(o.where("late").drop("late"), o.where("not late").drop("late")), ["n"])
    return changes.select("path", "status", "negligible", F.round(F.coalesce("head_size", F.lit(0.0)) - F.coalesce("base_size", F.lit(0.0)), 2).alias("delta"))


def e30_outcomes(spark, sf):
    """Every file and rule with its errors, and whether the rule succeeded there (E-30)."""
    return L.outcomes(_scopes(spark, sf), L.threshold_rules(LIMITS))


def m09_lint_diff(spark, sf):
    """New violations: messages compared without their numbers (F-09, J-02, L-15)."""
    v = e30_lint(spark, sf).select("rule", F.col("file_id").alias("file"), F.concat(F.col("subject"), F.lit(" has "), F.col("value").cast("int")).alias("message"))
    head, base = v.where("cast(substring(file, 2) as bigint) % 3 <> 0"), v.where("cast(substring(file, 2) as bigint) % 2 = 0")
    return V.lint_diff(head, base, X.lint_message_key("message"))


def quality_tables(spark, sf):
    """Production classes, dependencies on classes, and test files, from the measurements.

    A function is named ``Class.method``: a file that measures it depends on the class.  The first class of a production file
    stands for the file's own in the links between classes.
    """
    flag = load(spark, sf, "files").select("file_id", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    m = measured(spark, sf).where("item_name is not null").join(flag, "file_id").withColumnRenamed("repo", "scope")
    c = m.where("kind = 'class'")
    classes = c.where("not is_test").groupBy("scope", F.col("item_name").alias("class_name")).agg(F.min("file_id").alias("file_id"), F.max("cyclomatic_complexity").alias("ccn"), F.max("efferent").alias("efferent"), F.max("afferent").alias("afferent"))
    dependencies = m.where("kind = 'function'").select("scope", "file_id", "is_test", F.split("item_name", r"\.")[0].alias("class_name"), F.lit(None).cast("string").alias("namespace")).distinct()
    own = c.groupBy("file_id").agg(F.min("item_name").alias("src"))
    known = classes.select("scope", "class_name")
    links = dependencies.where("not is_test").join(own, "file_id").select("scope", "src", F.col("class_name").alias("dst")).where("src <> dst").distinct()
    links = links.join(known.withColumnRenamed("class_name", "src"), ["scope", "src"], "left_semi").join(known.withColumnRenamed("class_name", "dst"), ["scope", "dst"], "left_semi")
    tests = load(spark, sf, "files").where("is_test").select(F.col("repo").alias("scope"), "file_id")
    return classes, dependencies, links, tests


def _test_files(spark, sf):
    classes, dependencies, links, tests = quality_tables(spark, sf)
    touched = cut_lineage(Q.touched_classes(classes, dependencies))
    return classes, touched, Q.test_files(tests, touched, Q.chain_depth(touched, cut_lineage(links)))


def f04_touched_classes(spark, sf):
    """Production classes that each test file touches (F-04)."""
    classes, dependencies, _, _ = quality_tables(spark, sf)
    return Q.touched_classes(classes, dependencies)


def f05_untested_classes(spark, sf):
    """Production classes that no test touches (F-05)."""
    classes, dependencies, _, _ = quality_tables(spark, sf)
    return Q.untested_classes(classes, Q.touched_classes(classes, dependencies)).select("scope", "class_name", "weight")


def d17_test_isolation(spark, sf):
    """Fan-out, depth through production classes, isolation score and label of each test file (D-17, K-17)."""
    return _test_files(spark, sf)[2]


def g17_test_histogram(spark, sf):
    """Test files by isolation score in five bins of 20 (G-17)."""
    t = _test_files(spark, sf)[2]
    return t.groupBy(F.least(F.floor(F.col("score") / 20), F.lit(4)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def g16_test_quality(spark, sf):
    """Classes, tested classes, traceability, test files and mean isolation of each repo (G-16, N-08)."""
    return Q.totals(*_test_files(spark, sf))


def i04_god_tests(spark, sf, least: int = 5, limit: int = 20):
    """Test files that touch at least ``least`` production classes, the widest first (I-04)."""
    t = _test_files(spark, sf)[2]
    return t.where(F.col("fan_out") >= least).select("file_id", "fan_out", "label").orderBy(F.col("fan_out").desc(), "file_id").limit(limit)


def i05_orphans(spark, sf, limit: int = 20):
    """Untested production classes by orphan weight, the heaviest first (I-05)."""
    return f05_untested_classes(spark, sf).orderBy(F.col("weight").desc(), "scope", "class_name").limit(limit)


def l01_tokens(spark, sf):
    """Number of tokens, distinct tokens and bigrams of each document (L-01, L-02)."""
    d = load(spark, sf, "documents").select("doc_id", X.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.size(X.ngrams("t", 2, 2)).alias("n_bigrams"))


def l03_murmur(spark, sf):
    """Murmur3 and hash bin of each distinct token of all documents."""
    w = load(spark, sf, "documents").select(F.explode(X.tokens("text")).alias("token")).distinct()
    return w.withColumn("hash", X.murmur3("token")).withColumn("bin", X.hash_bin("hash", 32768))


def l04_hashing_tfidf(spark, sf):
    """L2-normalised hashing TF-IDF of each document: 1 + ln(tf) times smoothed idf."""
    return T.hashing_tfidf(load(spark, sf, "documents").select("doc_id", X.tokens("text").alias("tokens")), "doc_id")


def l01_frequent_words(spark, sf, share: float = 0.3):
    """Stop words by rule: tokens that at least ``share`` of all documents hold."""
    return T.frequent_words(load(spark, sf, "documents").select("doc_id", X.tokens("text").alias("tokens")), "doc_id", share)


def l05_tfidf(spark, sf):
    """Vocabulary TF-IDF of each document's tokens."""
    return T.tfidf(load(spark, sf, "documents").select("doc_id", X.tokens("text").alias("tokens")), "doc_id")


def l06_centroid_ranking(spark, sf):
    """The three vectors closest to the centroid of each label, by cosine (cluster naming)."""
    e = load(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    w = Window.partitionBy("label").orderBy(F.col("cosine").desc(), "vec_id")
    scored = e.join(F.broadcast(centroid), "label").select("label", "vec_id", F.round(X.cosine("embedding", "c"), 6).alias("cosine"))
    return scored.withColumn("place", F.row_number().over(w)).where("place <= 3")


def l08_fallback_names(spark, sf):
    """Most frequent name part of each repo's packages, generic parts skipped."""
    p = load(spark, sf, "edges").where("src is not null").select("repo", F.explode(F.split("src", r"\.")).alias("part")).where(~F.col("part").isin("core", "app", "internal", "shared", "util", "common", "model"))
    counts = p.groupBy("repo", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("repo").orderBy(F.col("n").desc(), "part")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("repo", "part", "n")


def l09_one_hot(spark, sf, weight: float = 2.5):
    """Label encoding of each file's language, and one weighted column a language (L-09); unknown languages are -1 and all 0."""
    f = load(spark, sf, "files")
    code, hot = X.one_hot("programming_language", LANGUAGE_CODES, weight)
    return f.select("file_id", code.alias("code"), *[h.alias(n) for n, h in hot.items()])


def predictions(spark, sf):
    """``(file, class, predictions)`` of a stand-in classifier: the shares of each label among the records of a class's language and size."""
    s = load(spark, sf, "class_samples").where("label is not null").withColumn("cell", F.concat_ws("|", F.lower(F.trim("programming_language")), F.least(F.floor(F.coalesce("class_loc", F.lit(0)) / 40), F.lit(5))))
    n = s.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    shares = n.groupBy("cell").agg(F.sum("n").alias("whole"), F.collect_list(F.struct("n", "label")).alias("ls"))  # as many entries as labels
    ranked = F.transform(F.array_sort(F.transform("ls", lambda x: F.struct((-x["n"]).alias("minus"), x["label"].alias("label")))), lambda x: F.struct(x["label"].alias("label"), F.round(-x["minus"] / F.col("whole"), 9).alias("probability")))
    return s.select("sample_id", "cell").join(shares.select("cell", ranked.alias("predictions")), "cell").select("sample_id", "predictions")


def l12_ambiguities(spark, sf):
    """Records whose two best labels lie within 0.1, with the three best and the pattern's name, the closest first (L-12, I-12)."""
    return T.ambiguities(predictions(spark, sf), "sample_id").select("sample_id", "gap", "labels", "pattern")


def l16_checksums(spark, sf):
    """SHA-256 of each file's text, slug of its language, and the cache key of time and size (L-16 to L-18)."""
    return load(spark, sf, "files").select("file_id", F.sha2("source_text", 256).alias("sha"), X.slug(F.regexp_replace("programming_language", "#", "-sharp")).alias("slug"), X.cache_key("scanned_at", F.octet_length("source_text")).alias("cache_key"))


def l18_initials(spark, sf):
    """Initials and avatar address of every author (L-18)."""
    return load(spark, sf, "authors").select("identity_id", X.initials("author").alias("initials"), X.avatar("email").alias("avatar"))


def l18_colours(spark, sf):
    """Colour of every author, by a hash of the name."""
    return load(spark, sf, "authors").select("identity_id", X.contributor_colour("author").alias("colour"))


QUERIES = {f.__name__: f for f in (
    e30_lint, e30_outcomes, e30_severities, b15_lint_report, e20_files_per_package, e21_package_in_name, e22_slice_prealloc, e35_role_violations, e36_risk_items, e40_suggestions, m03_function_findings, m06_index_findings, m11_gate, m02_file_delta, m09_lint_diff,
    f04_touched_classes, f05_untested_classes, d17_test_isolation, g17_test_histogram, g16_test_quality, i04_god_tests, i05_orphans, l01_tokens, l03_murmur, l01_frequent_words, l04_hashing_tfidf, l05_tfidf, l06_centroid_ranking, l08_fallback_names, l09_one_hot, l12_ambiguities, l16_checksums, l18_initials, l18_colours,
)}

_RULES = [  # (rule, ruleset, severity, kind, condition, value, first hit only)
    ("afferent_coupling", "architecture", "unknown", "file", "afferent > 6", "afferent", 0), ("efferent_coupling", "architecture", "unknown", "file", "efferent > 8", "efferent", 0),
    ("maintainability", "architecture", "high", "class", "trunc(mi) < 80", "mi", 1), ("no_circular_dependencies", "architecture", "low", "file", "instability > 0.8 AND afferent > 0 AND efferent > 0", "instability", 0),
    ("max_responsibilities", "architecture", "medium", "class", "afferent % 5 > 3", "afferent % 5", 1), ("max_loc", "volume", "medium", "file", "loc > 150", "loc", 0), ("max_lloc", "volume", "medium", "file", "loc - 5 > 120", "loc - 5", 0),
    ("max_loc_by_method", "volume", "medium", "function", "loc > 30", "loc", 0), ("max_lloc_by_method", "volume", "medium", "function", "loc - 5 > 28", "loc - 5", 0), ("max_methods_per_class", "volume", "medium", "class", "efferent > 8", "efferent", 0),
    ("max_public_methods", "volume", "medium", "class", "efferent - 1 > 6", "efferent - 1", 0), ("max_switch_cases", "volume", "medium", "file", "ccn > 25", "ccn", 0), ("max_nested_blocks", "volume", "medium", "file", "ccn > 30", "ccn", 0),
    ("max_parameters_per_method", "volume", "medium", "function", "afferent % 6 > 3", "afferent % 6", 1), ("cyclomatic_complexity", "complexity", "medium", "file", "ccn > 20", "ccn", 0), ("max_nesting_depth", "complexity", "medium", "function", "ccn % 7 > 4", "ccn % 7", 0),
    ("max_file_size", "golang", "medium", "file", "loc > 300", "loc", 0),
]
_LINT = f"{MEASURED}, q AS (SELECT *, maintainability_index AS mi, cyclomatic_complexity AS ccn FROM measured), v0 AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS rule, '{rs}' AS ruleset, '{sev}' AS severity, file_id, CAST(item_id AS VARCHAR) AS subject, CAST({val} AS DOUBLE) AS value, {first} AS first_only FROM q WHERE kind = '{kind}' AND {cond}" for k, rs, sev, kind, cond, val, first in _RULES
) + "), v AS (SELECT rule, ruleset, severity, file_id, subject, value FROM (SELECT *, row_number() OVER (PARTITION BY rule, file_id ORDER BY subject) AS r FROM v0) WHERE first_only = 0 OR r = 1)"
_REV = f"""{MEASURED}, m0 AS (SELECT CAST(item_id AS VARCHAR) AS subject, cyclomatic_complexity AS ccn, maintainability_index AS mi, efferent, item_id AS i FROM measured WHERE kind IN ('function', 'class')), base AS (SELECT * FROM m0 WHERE i % 11 <> 0),
    head AS (SELECT subject, ccn + CASE WHEN i % 3 = 0 THEN 9 WHEN i % 3 = 1 THEN -2 ELSE 0 END AS ccn, mi + CASE WHEN i % 5 = 0 THEN -60 WHEN i % 5 = 1 THEN 20 ELSE 0 END AS mi, efferent + CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END AS efferent FROM m0 WHERE i % 13 <> 0),
    j AS (SELECT h.subject, h.ccn AS after, b.ccn AS before, h.mi AS mi1, b.mi AS mi0, h.efferent AS ce1, b.efferent AS ce0, b.subject IS NOT NULL AS known FROM head h LEFT JOIN base b ON b.subject = h.subject),
    fn AS (SELECT CASE WHEN before IS NULL AND after >= 10 THEN 'new-complex-function' WHEN after > before AND after >= 10 THEN 'complexity-regression' WHEN before - after >= 3 THEN 'complexity-improvement' END AS kind,
        CASE WHEN before IS NULL AND after >= 10 THEN CASE WHEN after >= 25 THEN 'high' ELSE 'medium' END WHEN after > before AND after >= 10 THEN CASE WHEN after >= 25 OR after - before >= 10 THEN 'high' ELSE 'medium' END WHEN before - after >= 3 THEN 'low' END AS severity, subject, before, after FROM j),
    ix AS (SELECT subject, 'maintainability-regression' AS kind, CASE WHEN mi1 < 65 THEN 'high' ELSE 'medium' END AS severity, round(mi0, 6) AS before, round(mi1, 6) AS after FROM j WHERE known AND mi0 - mi1 >= 5 AND mi1 < 85
        UNION ALL SELECT subject, 'maintainability-improvement', 'low', round(mi0, 6), round(mi1, 6) FROM j WHERE known AND mi1 - mi0 >= 5 AND mi0 < 85
        UNION ALL SELECT subject, 'coupling-regression', 'medium', CAST(ce0 AS DOUBLE), CAST(ce1 AS DOUBLE) FROM j WHERE known AND ce1 - ce0 >= 3)"""
_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM documents)"
_ROLES = "ro AS (SELECT node, CASE split_part(node, '.', -1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_OF.items()) + " ELSE 'component:domain:value_object' END AS role FROM (SELECT src AS node FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL))"
_WEIGHT = "greatest(1, coalesce(ccn, 0) * (1 + efferent + afferent))"
_TESTS = f"""{MEASURED}, mt AS (SELECT m.*, coalesce(f.is_test, false) AS is_test FROM measured m JOIN files f ON f.file_id = m.file_id WHERE item_name IS NOT NULL),
    cl AS (SELECT repo AS scope, item_name AS class_name, min(file_id) AS file_id, max(cyclomatic_complexity) AS ccn, max(efferent) AS efferent, max(afferent) AS afferent FROM mt WHERE kind = 'class' AND NOT is_test GROUP BY 1, 2),
    dp AS (SELECT DISTINCT repo AS scope, file_id, is_test, split_part(item_name, '.', 1) AS class_name FROM mt WHERE kind = 'function'), ow AS (SELECT file_id, min(item_name) AS src FROM mt WHERE kind = 'class' GROUP BY 1),
    ln AS (SELECT DISTINCT dp.scope, src, dp.class_name AS dst FROM dp JOIN ow ON ow.file_id = dp.file_id WHERE NOT is_test AND src <> class_name AND (dp.scope, src) IN (SELECT (scope, class_name) FROM cl) AND (dp.scope, dp.class_name) IN (SELECT (scope, class_name) FROM cl)),
    tc AS (SELECT DISTINCT dp.scope, dp.file_id, dp.class_name FROM dp JOIN cl ON cl.scope = dp.scope AND cl.class_name = dp.class_name WHERE is_test),
    wk AS (SELECT scope, file_id, class_name AS node, 0 AS depth FROM tc UNION SELECT wk.scope, wk.file_id, dst, depth + 1 FROM wk JOIN ln ON ln.scope = wk.scope AND ln.src = wk.node WHERE depth < 4),
    dd AS (SELECT scope, file_id, max(d) AS depth FROM (SELECT scope, file_id, node, min(depth) AS d FROM wk GROUP BY 1, 2, 3) GROUP BY 1, 2), fo AS (SELECT scope, file_id, count(*) AS fan_out FROM tc GROUP BY 1, 2),
    tf0 AS (SELECT DISTINCT f.repo AS scope, f.file_id, coalesce(fan_out, 0) AS fan_out, coalesce(depth, 0) AS depth FROM files f LEFT JOIN fo ON fo.scope = f.repo AND fo.file_id = f.file_id LEFT JOIN dd ON dd.scope = f.repo AND dd.file_id = f.file_id WHERE is_test),
    tf AS (SELECT *, greatest(0, least(100, 100 - 10 * fan_out - 5 * depth)) AS score, CASE WHEN 100 - 10 * fan_out - 5 * depth >= 80 THEN 'Isolated' WHEN 100 - 10 * fan_out - 5 * depth >= 50 THEN 'Semi-isolated' ELSE 'Coupled' END AS label FROM tf0)"""

_PREDICTED = "WITH s AS (SELECT sample_id, label, lower(trim(programming_language)) || '|' || least(coalesce(class_loc, 0) // 40, 5) AS cell0, CASE WHEN programming_language IS NULL THEN CAST(least(coalesce(class_loc, 0) // 40, 5) AS VARCHAR) ELSE lower(trim(programming_language)) || '|' || least(coalesce(class_loc, 0) // 40, 5) END AS cell FROM class_samples WHERE label IS NOT NULL), n AS (SELECT cell, label, count(*) AS n FROM s GROUP BY 1, 2), w AS (SELECT *, round(n / sum(n) OVER (PARTITION BY cell)::DOUBLE, 9) AS p, row_number() OVER (PARTITION BY cell ORDER BY n DESC, label) AS r FROM n)"

SQL = {
    "e30_lint": f"WITH {_LINT} SELECT * FROM v",
    "e30_severities": f"WITH {_LINT} SELECT severity, count(*) AS n FROM v GROUP BY severity",
    "b15_lint_report": f"WITH {_LINT} SELECT file_id, count(*) AS n, string_agg(rule || ' ' || subject, '; ' ORDER BY rule || ' ' || subject) AS messages FROM v GROUP BY file_id",
    "e20_files_per_package": "SELECT repo, regexp_replace(short_path, '/?[^/]*$', '') AS folder, count(*) AS n FROM files WHERE NOT regexp_matches(short_path, '_test\\.go$|(^|/)doc\\.go$') GROUP BY 1, 2 HAVING count(*) > 5",
    "e21_package_in_name": "SELECT item_id, split_part(item_name, '.', -1) AS name, lower(split_part(path, '/', -2)) AS package FROM metrics WHERE kind = 'function' AND item_name IS NOT NULL AND length(split_part(path, '/', -2)) > 2 AND contains(lower(split_part(item_name, '.', -1)), lower(split_part(path, '/', -2)))",
    "e22_slice_prealloc": f"SELECT file_id, CAST(n AS INTEGER) AS n FROM (SELECT file_id, len(list_filter(regexp_extract_all(source_text, '{_BOUNDED_FOR}'), lambda b: regexp_matches(b, '{_APPEND}'))) AS n FROM files WHERE programming_language = 'Golang') WHERE n > 0",
    "e35_role_violations": f"""WITH {_ROLES} SELECT a.role AS from_role, b.role AS to_role, count(*) AS n FROM edges e JOIN ro a ON a.node = e.src JOIN ro b ON b.node = e.dst
        WHERE (a.role LIKE 'component:interface:controller' AND b.role LIKE 'infrastructure:%') OR (split_part(a.role, ':', 2) = 'domain' AND split_part(b.role, ':', 2) = 'app') OR (split_part(a.role, ':', 2) = 'data_access' AND split_part(b.role, ':', 3) = 'interface')
           OR (split_part(a.role, ':', 2) = 'domain' AND split_part(a.role, ':', 3) = 'rule' AND NOT (split_part(b.role, ':', 2) = 'domain' AND split_part(b.role, ':', 3) IN ('entity', 'value_object'))) GROUP BY 1, 2""",
    "e36_risk_items": f"""WITH {MEASURED}, f AS (SELECT m.file_id, any_value(programming_language) AS language, count(*) FILTER (kind = 'class') AS nc, count(*) FILTER (kind = 'function') AS nm, sum(h_volume / 3000) FILTER (kind = 'file') AS bugs, max(afferent) - 4 AS lcom4, max(efferent) AS ce FROM measured m JOIN files f ON f.file_id = m.file_id GROUP BY m.file_id)
        SELECT file_id, 'too many classes' AS risk, round(least(1.0, 0.6 + 0.05 * (nc - 3)), 6) AS severity FROM f WHERE language = 'Golang' AND nc > 3 UNION ALL SELECT file_id, 'too bugged', round(least(1.0, bugs / 2 + 0.3), 6) FROM f WHERE bugs >= 0.5
        UNION ALL SELECT file_id, 'too many responsibilities', greatest(CASE WHEN nm >= 30 THEN 0.8 WHEN nm >= 20 THEN 0.5 ELSE 0.0 END, CASE WHEN lcom4 > 1 THEN 0.7 ELSE 0.0 END) FROM f WHERE nm >= 20 OR lcom4 > 1 UNION ALL SELECT file_id, 'too many efferent couplings', CASE WHEN ce >= 40 THEN 0.85 ELSE 0.6 END FROM f WHERE ce >= 20""",
    "e40_suggestions": f"""WITH {MEASURED}, k AS (SELECT file_id, count(DISTINCT repo || ' ' || hash) AS n FROM commits WHERE file_id IS NOT NULL GROUP BY file_id), f AS (SELECT m.file_id, n, max(risk_score) AS risk, max(cyclomatic_complexity) AS ccn FROM measured m JOIN k ON k.file_id = m.file_id WHERE kind = 'file' GROUP BY 1, 2),
        s0 AS (SELECT file_id, 'hotspot' AS kind, file_id AS location FROM f WHERE risk >= 0.7 AND n >= 3 UNION ALL SELECT file_id, 'low maintainability', coalesce(item_name, '') FROM measured WHERE kind = 'class' AND maintainability_index < 65 UNION ALL SELECT file_id, 'complex and busy', file_id FROM f WHERE ccn > 50 AND n >= 3),
        s AS (SELECT kind, location, min(file_id) AS file_id FROM s0 GROUP BY 1, 2), c AS (SELECT file_id, count(*) AS k, sum(count(*)) OVER (ORDER BY file_id) - count(*) AS ahead FROM s GROUP BY 1)
        SELECT s.file_id, kind, location FROM s JOIN c ON c.file_id = s.file_id WHERE ahead < 10""",
    "m03_function_findings": f"WITH {_REV} SELECT * FROM fn WHERE kind IS NOT NULL",
    "m06_index_findings": f"WITH {_REV} SELECT * FROM ix",
    "m11_gate": f"WITH {_REV}, a AS (SELECT kind, severity FROM fn WHERE kind IS NOT NULL UNION ALL SELECT kind, severity FROM ix), l AS (SELECT * FROM (VALUES ('high', 1), ('medium', 2), ('any', 3), ('never', 0)) v(level, k)), n AS (SELECT level, count(kind) AS n FROM l LEFT JOIN a ON NOT ends_with(kind, 'improvement') AND CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END <= k GROUP BY level) SELECT level, n > 0 AS failed, n FROM n",
    "m02_file_delta": """WITH o AS (SELECT o_custkey || '/' || o_orderstatus AS path, month(o_orderdate) > 6 AS late, count(*) AS n, round(sum(o_totalprice), 2) AS size, max(o_orderkey) AS ck FROM orders GROUP BY 1, 2),
        j AS (SELECT coalesce(h.path, b.path) AS path, h.ck AS hc, b.ck AS bc, h.n AS hn, b.n AS bn, h.size AS hs, b.size AS bs FROM (SELECT * FROM o WHERE late) h FULL JOIN (SELECT * FROM o WHERE NOT late) b ON b.path = h.path)
        SELECT path, CASE WHEN bc IS NULL THEN 'added' WHEN hc IS NULL THEN 'deleted' ELSE 'changed' END AS status, hc IS NOT NULL AND bc IS NOT NULL AND hn = bn AS negligible, round(coalesce(hs, 0.0) - coalesce(bs, 0.0), 2) AS delta FROM j WHERE bc IS NULL OR hc IS NULL OR hc <> bc""",
    "m09_lint_diff": f"WITH {_LINT}, w AS (SELECT rule, file_id AS file, subject || ' has ' || CAST(trunc(value) AS INTEGER) AS message FROM v), k AS (SELECT *, regexp_replace(message, '[0-9]+', '#', 'g') AS kk, CAST(substr(file, 2) AS BIGINT) AS i FROM w) SELECT rule, file, message FROM k h WHERE i % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.i % 2 = 0 AND b.rule = h.rule AND b.file = h.file AND b.kk = h.kk)",
    "g16_test_quality": f"""WITH RECURSIVE {_TESTS}, c AS (SELECT cl.scope, count(*) AS n_classes, count(*) FILTER ((cl.scope, cl.class_name) IN (SELECT (scope, class_name) FROM tc)) AS n_tested FROM cl GROUP BY 1), t AS (SELECT scope, count(*) AS n_test_files, avg(score) AS iso FROM tf GROUP BY 1),
        j AS (SELECT coalesce(c.scope, t.scope) AS scope, coalesce(n_classes, 0) AS n_classes, coalesce(n_tested, 0) AS n_tested, coalesce(n_test_files, 0) AS n_test_files, round(coalesce(iso, 0.0), 6) AS isolation FROM c FULL JOIN t ON t.scope = c.scope)
        SELECT scope, n_classes, n_tested, CASE WHEN n_classes > 0 THEN round(n_tested * 100 / n_classes::DOUBLE, 6) ELSE 0.0 END AS traceability, n_test_files, isolation, CASE WHEN isolation >= 80 THEN 'Isolated' WHEN isolation >= 50 THEN 'Semi-isolated' ELSE 'Coupled' END AS label FROM j""",
    "i04_god_tests": f"WITH RECURSIVE {_TESTS} SELECT file_id, fan_out, label FROM tf WHERE fan_out >= 5 ORDER BY fan_out DESC, file_id LIMIT 20",
    "i05_orphans": f"WITH RECURSIVE {_TESTS} SELECT scope, class_name, {_WEIGHT} AS weight FROM cl WHERE (scope, class_name) NOT IN (SELECT (scope, class_name) FROM tc) ORDER BY weight DESC, scope, class_name LIMIT 20",
    "l01_tokens": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS t FROM documents) SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, CAST(greatest(len(t) - 1, 0) AS INTEGER) AS n_bigrams FROM t",
    "l05_tfidf": f"WITH {_TOK}, tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1) SELECT doc_id, tf.token, round((1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1), 9) AS weight FROM tf JOIN df ON df.token = tf.token",
    "l06_centroid_ranking": """WITH d AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS x FROM d GROUP BY 1, 2),
        s AS (SELECT d.label, vec_id, round(sum(CAST(d.x AS DOUBLE) * c.x) / (sqrt(sum(CAST(d.x AS DOUBLE) * d.x)) * sqrt(sum(c.x * c.x))), 6) AS cosine FROM d JOIN c ON c.label = d.label AND c.d = d.d GROUP BY 1, 2)
        SELECT label, vec_id, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS place FROM s) WHERE place <= 3""",
    "l08_fallback_names": "WITH p AS (SELECT repo, unnest(string_split(src, '.')) AS part FROM edges WHERE src IS NOT NULL), c AS (SELECT repo, part, count(*) AS n FROM p WHERE part NOT IN ('core', 'app', 'internal', 'shared', 'util', 'common', 'model') GROUP BY 1, 2) SELECT repo, part, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, part) AS r FROM c) WHERE r = 1",
    "l09_one_hot": "SELECT file_id, CASE programming_language " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANGUAGE_CODES)) + " ELSE -1 END::BIGINT AS code, " + ", ".join(f"CASE WHEN programming_language = '{x}' THEN 2.5::DOUBLE ELSE 0.0 END AS is_{x.lower().replace('#', 'sharp')}" for x in LANGUAGE_CODES) + " FROM files",
    "l16_checksums": "SELECT file_id, sha256(source_text) AS sha, regexp_replace(regexp_replace(lower(trim(replace(programming_language, '#', '-sharp'))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CAST(epoch_us(scanned_at) * 1000 AS VARCHAR) || '_' || octet_length(encode(source_text)) AS cache_key FROM files",
    "f04_touched_classes": f"WITH RECURSIVE {_TESTS} SELECT scope, file_id, class_name FROM tc",
    "f05_untested_classes": f"WITH RECURSIVE {_TESTS} SELECT scope, class_name, {_WEIGHT} AS weight FROM cl WHERE (scope, class_name) NOT IN (SELECT (scope, class_name) FROM tc)",
    "d17_test_isolation": f"WITH RECURSIVE {_TESTS} SELECT scope, file_id, fan_out, depth, score, label FROM tf",
    "g17_test_histogram": f"WITH RECURSIVE {_TESTS} SELECT CAST(least(score // 20, 4) AS INTEGER) AS bin, count(*) AS n FROM tf GROUP BY 1",
    "l01_frequent_words": f"WITH {_TOK} SELECT token, count(DISTINCT doc_id) AS n_documents FROM tok GROUP BY 1 HAVING count(DISTINCT doc_id) >= 0.3 * (SELECT count(*) FROM documents)",
    "l12_ambiguities": _PREDICTED + """, a AS (SELECT cell, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2, max(label) FILTER (r = 1) AS l1, max(label) FILTER (r = 2) AS l2, string_agg(label, ';' ORDER BY r) FILTER (r <= 3) AS labels FROM w GROUP BY 1)
        SELECT sample_id, round(p1 - p2, 6) AS gap, labels, l1 || ' + ' || l2 AS pattern FROM s JOIN a ON a.cell = s.cell WHERE p1 - p2 < 0.1""",
    "l18_initials": """WITH a AS (SELECT identity_id, author, lower(trim(email)) AS e, list_filter(list_transform(regexp_split_to_array(trim(author), '\\s+'), lambda w: upper(regexp_extract(w, '(\\p{L})', 1))), lambda x: x <> '') AS ls FROM authors)
        SELECT identity_id, CASE WHEN author IS NULL OR author = '' THEN '?' WHEN len(ls) > 0 THEN substr(array_to_string(ls, ''), 1, 3) ELSE upper(substr(trim(author), 1, 1)) END AS initials,
               CASE WHEN contains(e, '@') THEN 'https://www.gravatar.com/avatar/' || md5(e) || '?s=80&d=404' ELSE '' END AS avatar FROM a""",
    "e30_outcomes": f"""WITH {_LINT}, ru AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}', '{r[3]}')" for r in _RULES)}, ('no_god_class', 'class')) t(rule, kind)), ch AS (SELECT DISTINCT rule, file_id FROM q JOIN ru ON ru.kind = q.kind), er AS (SELECT rule, file_id, count(*) AS n FROM v GROUP BY 1, 2)
        SELECT ch.rule, ch.file_id, coalesce(n, 0) AS n_errors, n IS NULL AS succeeded FROM ch LEFT JOIN er ON er.rule = ch.rule AND er.file_id = ch.file_id""",
}
