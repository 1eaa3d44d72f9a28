"""Project-level rules, roles, features and report lists that build on the other plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.functions import text as X
from codeweft.operators import graph as G
from codeweft.operators import lint as L
from codeweft.operators.extract import extract_units
from codeweft.plans.adapters import MEASURED, measured
from codeweft.operators import text as T
from codeweft.plans.graph import _G, _L, _graph, _members, detected, k09_community_edges
from codeweft.plans.metrics import _FR, _RISK, _file_risk
from codeweft.plans.quality import _PREDICTED, _REV, _ROLES, e40_suggestions, g16_test_quality, i04_god_tests, i05_orphans, m03_function_findings, m06_index_findings, package_roles, predictions
from codeweft.plans.quality import SQL as QUALITY_SQL
from codeweft.session import load
from codeweft.sources.models import train_forest

R = lambda c, n=6: F.round(c, n)


def e25_project_rules(spark, sf):
    """Project rules: traceability and isolation below their limits, wide tests, heavy orphans (E-25 to E-28)."""
    project = g16_test_quality(spark, sf).select(F.col("scope").alias("file_id"), F.lit("project").alias("subject"), "traceability", "isolation")
    tests = i04_god_tests(spark, sf).select("file_id", F.lit("test").alias("subject"), "fan_out")
    orphans = i05_orphans(spark, sf).select(F.col("scope").alias("file_id"), F.col("class_name").alias("subject"), "weight")
    rules = L.threshold_rules({"min_traceability": 80, "min_isolation_score": 95, "max_god_test_fan_out": 5, "max_orphan_weight": 100})
    return L.evaluate({"project": project, "test": tests, "orphan": orphans}, rules).select("rule", "severity", "file_id", "subject", R(F.col("value")).alias("value"))


def e32_search(spark, sf, expression: str = "ledger.*gateway"):
    """Items whose path or name matches an expression, whatever the case."""
    hit = lambda c: F.coalesce(F.col(c).rlike("(?i)" + expression), F.lit(False))
    return measured(spark, sf).where(hit("path") | hit("item_name")).select("item_id")


def e34_production(spark, sf):
    """Production files: no test and without errors, by language."""
    f = load(spark, sf, "files").where("not coalesce(is_test, false) and (errors is null or size(errors) = 0)")
    return f.groupBy("programming_language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("loc"))


def _suggested(graph, members, coupling: float, size: int, purity: float, boundary: int):
    """Suggestions of E-41: coupling above, size above with purity below, and the first boundary nodes by name."""
    links = G.community_coupling(G.community_edges(graph, members))
    facts = G.purity(members).join(links, "community", "left")
    hits = F.array_compact(F.array(F.when(F.col("coupling") > coupling, F.lit("facade")), F.when((F.col("size") > size) & (F.col("purity") < purity), F.lit("split"))))
    by_community = facts.select(F.col("community").alias("location"), F.explode(hits).alias("suggestion"))
    nodes = G.boundary_nodes(graph, members).select(F.col("node").alias("location"), F.lit("boundary").alias("suggestion")).orderBy("location").limit(boundary)
    return by_community.unionByName(nodes)


def e41_community_suggestions(spark, sf, coupling: float = 0.7, size: int = 50, purity: float = 0.6, boundary: int = 5):
    """Suggestions over the given communities (E-41)."""
    return _suggested(_graph(spark, sf), _members(spark, sf), coupling, size, purity, boundary)


def e41_detected_suggestions(spark, sf, coupling: float = 0.7, size: int = 50, purity: float = 0.6, boundary: int = 5):
    """Suggestions over detected communities (E-41)."""
    return _suggested(*detected(spark, sf), coupling, size, purity, boundary)


def g24_role_flows(spark, sf):
    """Dependencies counted by role category on both ends (F-11, G-24, L-13)."""
    roles = package_roles(spark, sf).select("node", F.split("role", ":")[1].alias("category"))
    a, b = roles.select(F.col("node").alias("src"), F.col("category").alias("from_role")), roles.select(F.col("node").alias("dst"), F.col("category").alias("to_role"))
    e = G.dependency_graph(load(spark, sf, "edges"))
    return e.join(a, "src").join(b, "dst").groupBy("from_role", "to_role").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("weight"))


def f13_file_community(spark, sf):
    """Community of each file: its second folder if that is a community, else its first (coalesced key)."""
    communities = _members(spark, sf).select(F.col("community").alias("second"), F.lit(True).alias("known")).distinct()
    f = load(spark, sf, "files").select("file_id", F.try_element_at(F.split("short_path", "/"), F.lit(2)).alias("second"), F.split("short_path", "/")[0].alias("first"))
    return f.join(communities, "second", "left").select("file_id", F.when(F.col("known"), F.col("second")).otherwise(F.col("first")).alias("community"))


def c16_method_calls(spark, sf):
    """Calls on the current object in each file (this, self, $this), by name."""
    f = load(spark, sf, "files").where("source_text is not null")
    calls = F.regexp_extract_all("source_text", F.lit(r"(?:\$this->|\bthis\.|\bself\.)(\w+)\("), F.lit(1))
    return f.select("file_id", F.explode(calls).alias("name")).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"))


def c18_test_references(spark, sf):
    """Names that Go test files use and do not declare (anti join against declared names and builtins)."""
    builtins = spark.createDataFrame([(x,) for x in "len cap make new append panic print string int error nil true false return range func for if else package import struct type".split()], "name string")
    f = load(spark, sf, "files").where("programming_language = 'Golang' and short_path like '%\\_test.go' and source_text is not null")
    used = f.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("source_text", F.lit(r"\b[A-Za-z_]\w*\.([A-Z]\w*)\("), F.lit(1)))).alias("name"))
    declared = f.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("source_text", F.lit(r"(?m)^func \([^)]*\) (\w+)\("), F.lit(1)))).alias("name"))
    return used.join(declared, ["file_id", "name"], "left_anti").join(F.broadcast(builtins), "name", "left_anti").select("file_id", "name")


def c19_first_statement(spark, sf):
    """Name of the first class or function of each file's text (C-19)."""
    u = extract_units(load(spark, sf, "files")).where("kind in ('class', 'interface', 'function')")
    return u.groupBy("file_id").agg(F.min(F.struct("start_line", "name")).getField("name").alias("first_name"))


def i03_overview_top(spark, sf, least: float = 0.3, limit: int = 10, shown: int = 5):
    """Riskiest files above ``least`` and the first suggestions, as the overview lists them (I-03, N-01)."""
    top = _file_risk(spark, sf).where(F.col("risk") > least).select(F.lit("risk").alias("section"), F.col("file_id").alias("location"), R(F.col("risk")).alias("value")).orderBy(F.col("value").desc(), "location").limit(limit)
    first = e40_suggestions(spark, sf).orderBy("file_id", "kind", "location").limit(shown)
    return top.unionByName(first.select(F.col("kind").alias("section"), "location", F.lit(None).cast("double").alias("value")))


def i08_risk_entries(spark, sf, limit: int = 20):
    """Classes of the riskiest files, file by file, at most ``limit`` rows (I-08)."""
    files = _file_risk(spark, sf).select("file_id", R(F.col("risk")).alias("risk"))
    m = measured(spark, sf).where("kind = 'class' and item_name is not null").select("file_id", "item_id", "item_name")
    return m.join(files, "file_id").orderBy(F.col("risk").desc(), "file_id", "item_id").limit(limit)


#: Orders of the file table: the name ascending, numbers descending.
FILE_ORDERS = {"name": lambda: F.col("path").asc_nulls_last(), **{k: (lambda c=c: F.col(c).desc_nulls_last()) for k, c in (("loc", "loc"), ("commits", "n_commits"), ("ccn", "cyclomatic_complexity"), ("risk", "risk_score"))}}


def i10_file_table(spark, sf, by: str = "loc"):
    """Files with their numbers in the order ``by`` of the file table (I-10); ties by path and id."""
    counts = load(spark, sf, "commits").where("file_id is not null").groupBy("file_id").agg(F.count_distinct("repo", "hash").alias("n_commits"))
    f = measured(spark, sf).where("kind = 'file'").join(counts, "file_id", "left")
    return f.select("item_id", "path", "loc", F.coalesce("n_commits", F.lit(0)).alias("n_commits"), "cyclomatic_complexity", R(F.col("risk_score")).alias("risk_score")).orderBy(FILE_ORDERS[by](), "path", "item_id")


def i11_findings_order(spark, sf):
    """The 50 first findings by severity, subject and kind (I-11, B-14)."""
    found = m03_function_findings(spark, sf).select("kind", "severity", "subject").unionByName(m06_index_findings(spark, sf).select("kind", "severity", "subject"))
    return found.withColumn("rank", F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)).orderBy("rank", "subject", "kind").limit(50)


def i13_top_classes(spark, sf, top: int = 3, least: float = 0.01):
    """Up to ``top`` labels of each record with a probability of at least ``least`` (I-13)."""
    p = predictions(spark, sf)
    best = F.filter(F.slice("predictions", 1, top), lambda x: x["probability"] >= least)
    return p.select("sample_id", F.posexplode(best).alias("place", "p")).select("sample_id", "place", "p.label", R(F.col("p.probability")).alias("probability"))


def j04_shared_attributes(spark, sf):
    """Pairs of methods of a class that share an attribute, with the number shared (F-16): joined on the attribute."""
    o, l = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    t = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("class_id"), F.col("o_orderkey").alias("m"), F.col("l_suppkey").alias("a")).distinct()
    pair = t.alias("x").join(t.alias("y"), ["class_id", "a"]).where("x.m < y.m")
    return pair.groupBy("class_id", F.col("x.m").alias("m1"), F.col("y.m").alias("m2")).agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


def k20_community_sizes(spark, sf):
    s = _members(spark, sf).groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("n_communities"), R(F.avg("n")).alias("avg_size"), F.max("n").alias("max_size"))


def _word_vectors(spark, sf):
    """A vector for each word of the packages' names: those of the embeddings in turn (a word-vector file takes their place)."""
    words = _members(spark, sf).select(F.explode(X.identifier_words("node")).alias("word")).distinct()
    vectors = load(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").alias("vec"))
    n = vectors.count()
    numbered = vectors.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1)))).groupBy("slot").agg(F.min_by("vec", "vec_id").alias("vec"))
    return words.withColumn("slot", F.pmod(F.xxhash64("word"), F.lit(max(n, 1)))).join(numbered, "slot").select("word", "vec")


def k21_community_names(spark, sf):
    """Names of the detected communities by the words closest to their centroid (K-21, L-06)."""
    _, members = detected(spark, sf)
    return T.cluster_names(members.select(F.col("community").alias("cluster"), F.col("node").alias("name")), _word_vectors(spark, sf))


def n07_communities(spark, sf):
    """Detected communities with size, purity, edges inside and coupling, as the query API returns them (N-07)."""
    graph, members = detected(spark, sf)
    return G.purity(members).join(G.community_coupling(G.community_edges(graph, members)), "community", "left")


def n07_given_communities(spark, sf):
    """The same of given communities."""
    sizes = _members(spark, sf).groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(G.community_coupling(k09_community_edges(spark, sf)), "community")


def l14_nearest_centroid(spark, sf):
    """A trained baseline classifier: nearest class centroid over standardised numbers, and its confusion counts."""
    cols = ["class_loc", "nb_methods", "cyclomatic_complexity"]
    s = load(spark, sf, "class_samples").where("label is not null").select("sample_id", "label", *[F.log1p(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in cols])
    centroids = s.groupBy("label").agg(*[F.avg(c).alias(f"c_{c}") for c in cols]).withColumnRenamed("label", "guess")  # one row per label
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("guess", *[f"c_{c}" for c in cols]))).alias("centroids"))
    j = s.crossJoin(F.broadcast(packed))
    def closeness(x):
        d = sum(((F.col(c) - x[f"c_{c}"]) * (F.col(c) - x[f"c_{c}"]) for c in cols), F.lit(0.0))
        return F.struct(F.round(d, 9).alias("d"), x["guess"].alias("guess"))
    best = j.select("sample_id", "label", F.array_min(F.transform("centroids", closeness)).getField("guess").alias("guess"))
    return best.groupBy("label", "guess").agg(F.count(F.lit(1)).alias("n"))


def l14_forest(spark, sf):
    """Hashing TF-IDF of names and paths with the numbers into a random forest; labels and guesses of the held-out tenth (L-14)."""
    s = load(spark, sf, "class_samples").where("label is not null")
    words = F.concat(X.identifier_words(F.coalesce("class_name", F.lit(""))), X.identifier_words(F.coalesce("file_path", F.lit(""))))
    s = s.select("sample_id", "label", words.alias("words"), *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("class_loc", "nb_methods", "cyclomatic_complexity")])
    held = F.pmod(F.xxhash64("sample_id"), F.lit(10)) == 0
    model = train_forest(s.where(~held), "words", ["class_loc", "nb_methods", "cyclomatic_complexity"], "label")
    return model.transform(s.where(held)).groupBy("label", "guess").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    e25_project_rules, e32_search, e34_production, e41_community_suggestions, e41_detected_suggestions, g24_role_flows, f13_file_community, c16_method_calls, c18_test_references, c19_first_statement, i03_overview_top, i08_risk_entries, i10_file_table, i11_findings_order,
    i13_top_classes, j04_shared_attributes, k20_community_sizes, k21_community_names, n07_communities, n07_given_communities, l14_nearest_centroid, l14_forest,
)}

_COUPLING = _L + """, sz AS (SELECT community, count(*) AS size FROM m GROUP BY 1), s AS (SELECT community, CAST(sum(i) AS BIGINT) AS inside, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(n) AS BIGINT) AS incoming FROM (
    SELECT from_community AS community, CASE WHEN from_community = to_community THEN n_edges ELSE 0 END AS i, CASE WHEN from_community <> to_community THEN n_edges ELSE 0 END AS o, 0 AS n FROM l
    UNION ALL SELECT to_community, 0, 0, n_edges FROM l WHERE from_community <> to_community) GROUP BY community),
    cc AS (SELECT s.*, size, round(CASE WHEN inside + outgoing + incoming > 0 THEN outgoing / (inside + outgoing + incoming)::DOUBLE ELSE 0.0 END, 6) AS coupling FROM s JOIN sz ON sz.community = s.community)"""

_E40 = QUALITY_SQL["e40_suggestions"]
_TQ = QUALITY_SQL["g16_test_quality"], QUALITY_SQL["i04_god_tests"], QUALITY_SQL["i05_orphans"]

SQL = {
    "e32_search": "SELECT item_id FROM metrics WHERE coalesce(regexp_matches(path, '(?i)ledger.*gateway'), false) OR coalesce(regexp_matches(item_name, '(?i)ledger.*gateway'), false)",
    "e34_production": "SELECT programming_language, count(*) AS n_files, CAST(sum(loc) AS BIGINT) AS loc FROM files WHERE NOT coalesce(is_test, false) AND (errors IS NULL OR len(errors) = 0) GROUP BY 1",
    "e41_community_suggestions": f"""WITH {_COUPLING}, pu AS (SELECT community, max(n) / sum(n)::DOUBLE AS purity, sum(n) AS size FROM (SELECT community, split_part(node, '.', 1) AS ns, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
        bn AS (SELECT src FROM g JOIN m x ON x.node = src JOIN m y ON y.node = dst WHERE x.community <> y.community GROUP BY src HAVING count(DISTINCT y.community) >= 2 ORDER BY src LIMIT 5)
        SELECT community AS location, 'facade' AS suggestion FROM cc WHERE coupling > 0.7 UNION ALL SELECT community, 'split' FROM pu WHERE size > 50 AND purity < 0.6 UNION ALL SELECT src, 'boundary' FROM bn""",
    "g24_role_flows": f"WITH {_ROLES}, gg AS (SELECT src, dst, count(*) AS n FROM edges WHERE src <> dst GROUP BY 1, 2) SELECT split_part(x.role, ':', 2) AS from_role, split_part(y.role, ':', 2) AS to_role, count(*) AS n, CAST(sum(n) AS BIGINT) AS weight FROM gg JOIN ro x ON x.node = src JOIN ro y ON y.node = dst GROUP BY 1, 2",
    "f13_file_community": f"WITH {_G} SELECT file_id, CASE WHEN split_part(short_path, '/', 2) IN (SELECT community FROM m) THEN split_part(short_path, '/', 2) ELSE split_part(short_path, '/', 1) END AS community FROM files",
    "c16_method_calls": "SELECT file_id, name, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(source_text, '(?:\\$this->|\\bthis\\.|\\bself\\.)(\\w+)\\(', 1)) AS name FROM files) GROUP BY 1, 2",
    "c18_test_references": "WITH f AS (SELECT * FROM files WHERE programming_language = 'Golang' AND ends_with(short_path, '_test.go')) SELECT DISTINCT file_id, name FROM (SELECT file_id, unnest(regexp_extract_all(source_text, '\\b[A-Za-z_]\\w*\\.([A-Z]\\w*)\\(', 1)) AS name FROM f) EXCEPT SELECT file_id, unnest(regexp_extract_all(source_text, '(?m)^func \\([^)]*\\) (\\w+)\\(', 1)) FROM f",
    "i03_overview_top": f"""WITH {_FR}, t AS (SELECT max(n_commits) AS tc, max(ccn) AS tv FROM f), r AS (SELECT file_id, {_RISK.format(tc='tc', c='n_commits', tv='tv', v='coalesce(ccn, 0)')} AS raw FROM f, t), sg AS ({_E40})
        SELECT 'risk' AS section, file_id AS location, round(raw, 6) AS value FROM (SELECT * FROM r WHERE raw > 0.3 ORDER BY round(raw, 6) DESC, file_id LIMIT 10) UNION ALL SELECT kind, location, NULL FROM (SELECT * FROM sg ORDER BY file_id, kind, location LIMIT 5)""",
    "i10_file_table": "SELECT item_id, path, loc, coalesce(n_commits, 0) AS n_commits, cyclomatic_complexity, round(risk_score, 6) AS risk_score FROM metrics m LEFT JOIN (SELECT file_id, count(DISTINCT repo || ' ' || hash) AS n_commits FROM commits WHERE file_id IS NOT NULL GROUP BY 1) k ON k.file_id = m.file_id WHERE kind = 'file'",
    "i11_findings_order": f"WITH {_REV} SELECT kind, severity, subject, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM (SELECT kind, severity, subject FROM fn WHERE kind IS NOT NULL UNION ALL SELECT kind, severity, subject FROM ix) ORDER BY rank, subject, kind LIMIT 50",
    "j04_shared_attributes": "WITH t AS (SELECT DISTINCT o_custkey AS class_id, o_orderkey AS m, l_suppkey AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT x.class_id, x.m AS m1, y.m AS m2, count(*) AS shared FROM t x JOIN t y ON x.class_id = y.class_id AND x.a = y.a AND x.m < y.m GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "k20_community_sizes": f"WITH {_G} SELECT count(*) AS n_communities, round(avg(n), 6) AS avg_size, max(n) AS max_size FROM (SELECT community, count(*) AS n FROM m GROUP BY 1)",
    "n07_given_communities": f"WITH {_COUPLING} SELECT community, size, inside, outgoing, incoming, coupling FROM cc",
    "l14_nearest_centroid": """WITH s AS (SELECT sample_id, label, ln(1 + coalesce(class_loc, 0)) AS a, ln(1 + coalesce(nb_methods, 0)) AS b, ln(1 + coalesce(cyclomatic_complexity, 0)) AS c FROM class_samples WHERE label IS NOT NULL), k AS (SELECT label AS guess, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM s GROUP BY 1),
        d AS (SELECT sample_id, label, guess, row_number() OVER (PARTITION BY sample_id ORDER BY round((s.a - k.a) * (s.a - k.a) + (s.b - k.b) * (s.b - k.b) + (s.c - k.c) * (s.c - k.c), 9), guess) AS r FROM s, k) SELECT label, guess, count(*) AS n FROM d WHERE r = 1 GROUP BY 1, 2""",
    "i08_risk_entries": f"""WITH {_FR}, t AS (SELECT max(n_commits) AS tc, max(ccn) AS tv FROM f), r AS (SELECT file_id, round({_RISK.format(tc='tc', c='n_commits', tv='tv', v='coalesce(ccn, 0)')}, 6) AS risk FROM f, t)
        SELECT m.file_id, item_id, item_name, risk FROM metrics m JOIN r ON r.file_id = m.file_id WHERE kind = 'class' AND item_name IS NOT NULL ORDER BY risk DESC, m.file_id, item_id LIMIT 20""",
    "e25_project_rules": f"""WITH q AS ({_TQ[0]}), g AS ({_TQ[1]}), o AS ({_TQ[2]}) SELECT 'min_traceability' AS rule, 'high' AS severity, scope AS file_id, 'project' AS subject, round(traceability, 6) AS value FROM q WHERE traceability < 80 UNION ALL SELECT 'min_isolation_score', 'medium', scope, 'project', isolation FROM q WHERE isolation < 95
        UNION ALL SELECT 'max_god_test_fan_out', 'medium', file_id, 'test', CAST(fan_out AS DOUBLE) FROM g WHERE fan_out > 5 UNION ALL SELECT 'max_orphan_weight', 'medium', scope, class_name, CAST(weight AS DOUBLE) FROM o WHERE weight > 100""",
    "i13_top_classes": _PREDICTED + " SELECT sample_id, CAST(r - 1 AS INTEGER) AS place, w.label, round(p, 6) AS probability FROM s JOIN w ON w.cell = s.cell WHERE r <= 3 AND p >= 0.01",
}
