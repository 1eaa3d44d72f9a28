"""Sources (A), extraction (C), reports (B) and streaming (O)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.operators import extract as X
from codeweft.plans.adapters import MEASURED, measured
from codeweft.plans.quality import _LINT, e30_lint
from codeweft.session import load
from codeweft.sinks import reports as B
from codeweft.sources import files as S
from codeweft.sources import protobuf as P
from codeweft.sources.git import parse_log
from codeweft.streaming.activity import run_to_end, windowed_activity

R = lambda c, n=6: F.round(c, n)


def a03_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Files by language of their extension, and how many carry another one."""
    f = load(spark, sf, "files").withColumn("by_path", S.language_of(F.col("path")))
    return f.groupBy("by_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("programming_language") != F.col("by_path")).alias("n_other"))


def a04_not_excluded(spark, sf):
    """Files that the default exclusions keep."""
    return S.not_excluded(load(spark, sf, "files"), ["/vendor/", "/node_modules/", "^/tests/"]).select("file_id")


def a07_parse_errors(spark, sf):
    """Files with a reported parse error, and the number of files of each message."""
    f = load(spark, sf, "files").select("file_id", F.explode("errors").alias("error"))
    return f.groupBy(F.regexp_replace("error", "[0-9]+", "#").alias("error")).agg(F.count_distinct("file_id").alias("n_files"))


def a08_git_log(spark, sf):
    """The whole commit log written as git prints it and read back by the parser: commits with their number of paths."""
    c = load(spark, sf, "commit_log")
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    log = F.concat(F.lit("# "), F.concat_ws("|", text("hash"), text("author"), text("ts"), text("email")), F.lit("\n"), F.coalesce(F.array_join("files", "\n"), F.lit("")), F.lit("\n"))
    return parse_log(c.select("repo", log.alias("log"))).groupBy("repo", "hash", "author", "ts", "email").agg(F.count("file").alias("n"))


def a15_modules(spark, sf, marker: str = "go.mod"):
    """Each file with the deepest folder above it that holds a ``marker`` file; null where there is none (A-15)."""
    f = load(spark, sf, "files").select("file_id", "repo", "short_path")
    m = f.where(F.element_at(F.split("short_path", "/"), -1) == marker).select("repo", F.regexp_replace("short_path", "/?[^/]*$", "").alias("root")).distinct().withColumn("module", F.concat_ws(":", "repo", "root"))
    return S.module_of(f, m).select("file_id", "root", "module")


def a14_messages(spark, sf):
    """Files written as protocol buffer messages and read back (A-14)."""
    return P.load_messages(P.dump(load(spark, sf, "files")))


def c06_file_lines(spark, sf):
    """Lines of code, comment and logical lines of each file by the line scanner (C-06 to C-09)."""
    return X.file_lines(load(spark, sf, "files"))


def c08_line_count(spark, sf):
    """Lines of each file: the pieces between line ends."""
    return load(spark, sf, "files").where("source_text is not null").select("file_id", F.size(F.split("source_text", "\n", -1)).alias("loc"))


def c10_distinct_units(spark, sf):
    """First measurement of each class of a file, duplicates dropped (C-10, C-11), and functions outside classes (C-12)."""
    m = measured(spark, sf).where("kind = 'class' and item_name is not null").select("file_id", "item_name", "item_id")
    return X.distinct_units(m, ["item_name"], "item_id")


def c12_functions_outside(spark, sf):
    """Functions whose class is not measured in their file (anti join)."""
    m = measured(spark, sf).where("item_name is not null")
    f = m.where("kind = 'function'").select("item_id", "file_id", F.split("item_name", r"\.")[0].alias("item_name"))
    return f.join(m.where("kind = 'class'").select("file_id", "item_name").distinct(), ["file_id", "item_name"], "left_anti").select("item_id")


def j01_union_distinct(spark, sf):
    """Union of both directions of package relations, duplicates dropped (J-01, J-05)."""
    e = load(spark, sf, "edges")
    return e.select("repo", "src", "dst").unionAll(e.select("repo", F.col("dst"), F.col("src"))).distinct()


def c14_reduced_namespaces(spark, sf):
    """Package names reduced to one and two parts."""
    return load(spark, sf, "edges").where("src is not null").select("src").distinct().select("src", M.reduce_namespace("src", 1).alias("one"), M.reduce_namespace("src", 2).alias("two"))


def c17_test_files(spark, sf):
    """Files that are tests by name."""
    f = load(spark, sf, "files")
    return f.where(M.is_test_path("short_path", "programming_language")).select("file_id")


def c21_file_loc(spark, sf):
    """Logical and comment lines of each file: its own, else the sum over its functions with at least 1 each (C-20, C-21)."""
    fn = measured(spark, sf).where("kind = 'function'").groupBy("file_id").agg(F.sum(F.greatest(F.coalesce("loc", F.lit(1)), F.lit(1))).alias("s"))
    f = load(spark, sf, "files").select("file_id", "lloc", "cloc").join(fn, "file_id", "left")
    return f.select("file_id", F.coalesce(F.nullif("lloc", F.lit(0)), "s", F.lit(0)).alias("lloc"), F.coalesce("cloc", F.lit(0)).alias("cloc"))


def b02_json(spark, sf):
    """Each file's measurements as a JSON object, NaN as 0; read back to show that it parses."""
    m = load(spark, sf, "metrics").where("kind = 'file'").select("item_id", "path", "cyclomatic_complexity", "maintainability_index", "loc")
    back = B.json_rows(m, "item_id").select("item_id", F.from_json("json", "path string, cyclomatic_complexity int, maintainability_index double, loc int").alias("j"))
    return back.select("item_id", "j.path", "j.cyclomatic_complexity", R(F.col("j.maintainability_index")).alias("mi"), "j.loc")


def _file_gauges(spark, sf):
    """The ten gauges of each file: measurements, line counts, and the index without comments from both."""
    m = measured(spark, sf)
    counts = m.groupBy("file_id").agg(F.count_if(F.col("kind") == "function").alias("number_of_functions"), F.count_if(F.col("kind") == "class").alias("number_of_classes"))
    own = m.where("kind = 'file'").groupBy("file_id").agg(*[F.max(c).alias(c) for c in ("cyclomatic_complexity", "maintainability_index", "h_volume", "afferent", "efferent")])
    f = load(spark, sf, "files").select("file_id", "path", "loc", "lloc", "cloc").join(own, "file_id").join(counts, "file_id")
    woc = M.maintainability("loc", "lloc", "cloc", "cyclomatic_complexity", "h_volume")["mi_woc"]
    return f.select("path", "cyclomatic_complexity", F.col("loc").alias("lines_of_code"), F.col("lloc").alias("logical_lines_of_code"), F.col("cloc").alias("comment_lines_of_code"), F.col("maintainability_index").alias("maintainability"),
                    woc.alias("maintainability_without_comments"), "number_of_functions", "number_of_classes", F.col("afferent").alias("afferent_coupling"), F.col("efferent").alias("efferent_coupling"))


def b03_open_metrics(spark, sf):
    """Gauge lines of each file, and their HELP and TYPE lines (B-03)."""
    return B.open_metrics(_file_gauges(spark, sf), "path")


def b06_html_pages(spark, sf):
    """A page for the whole, each language and each root folder, with files and lines (B-06)."""
    f = load(spark, sf, "files").select("programming_language", F.split("short_path", "/")[0].alias("folder"), "loc")
    g = f.groupingSets([[], [F.col("programming_language")], [F.col("folder")]], "programming_language", "folder").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("files"), F.sum("loc").alias("lines"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "language").otherwise("directory")
    return B.html_pages(g.select(kind.alias("kind"), F.coalesce("programming_language", "folder", F.when(F.col("g") == 3, "all"), F.lit("none")).alias("name"), "files", "lines"))


def b10_dictionary(spark, sf):
    """Package relations with their names as numbers of a dictionary, read back through it (B-10)."""
    e = load(spark, sf, "edges").select("repo", "src", "dst", "weight")
    table, coded = B.dictionary(e, ["src", "dst"])
    for c in ("src", "dst"):
        coded = coded.join(table.select(F.col("id").alias(c), F.col("value").alias(f"{c}_name")), c, "left")
    return coded.groupBy("src_name", "dst_name").agg(F.count(F.lit(1)).alias("n"))


def b11_pruned_files(spark, sf):
    """Files with only what the report shows; the scan reads no text (B-11)."""
    return B.pruned(load(spark, sf, "files"), ["file_id", "short_path", "programming_language", "loc", "is_test"])


def b04_sarif(spark, sf):
    """SARIF results of the lint run."""
    v = e30_lint(spark, sf).select("rule", "severity", F.col("file_id").alias("file"), F.col("value").cast("int").alias("line"))
    return B.sarif_results(v)


def b08_folder_dependencies(spark, sf):
    """Package relations rolled up to the folders (all parts of the name but the last) of both sides, with edges and packages."""
    e = load(spark, sf, "edges").where("src is not null and dst is not null")
    folder = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    return e.groupBy(folder("src").alias("src_folder"), folder("dst").alias("dst_folder")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_packages"))


def b09_scopes(spark, sf):
    """Scopes of the report: all, then languages, then directories, with their number of files."""
    f = load(spark, sf, "files").select("programming_language", F.split("short_path", "/")[0].alias("folder"))
    g = f.groupingSets([[], [F.col("programming_language")], [F.col("folder")]], "programming_language", "folder").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "1-all").when(F.col("g") == 1, "2-language").otherwise("3-directory")
    return g.select(kind.alias("kind"), F.coalesce("programming_language", "folder", F.when(F.col("g") == 3, "all"), F.lit("")).alias("name"), "n")


def b12_chart(spark, sf):
    """Relations of each package as the chart's JSON list."""
    e = load(spark, sf, "edges").where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("src").agg(F.to_json(F.array_sort(F.collect_list(F.struct("dst", "n")))).alias("json")).select("src", F.get_json_object("json", "$[0].dst").alias("first_dst"), F.json_array_length("json").cast("bigint").alias("n_relations"))


def o01_stream_windows(spark, sf):
    """Events by hour and type through a stream read to its end."""
    schema = load(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_end(windowed_activity(stream), "activity_" + uuid.uuid4().hex).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (
    a03_languages, a04_not_excluded, a07_parse_errors, a08_git_log, a14_messages, a15_modules, c06_file_lines, c08_line_count, c10_distinct_units, c12_functions_outside, j01_union_distinct, c14_reduced_namespaces, c17_test_files, c21_file_loc,
    b02_json, b03_open_metrics, b06_html_pages, b10_dictionary, b11_pruned_files, b04_sarif, b08_folder_dependencies, b09_scopes, b12_chart, o01_stream_windows,
)}

_EXT = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'php' THEN 'PHP' WHEN 'go' THEN 'Golang' WHEN 'py' THEN 'Python' WHEN 'rs' THEN 'Rust' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'TypeScript' WHEN 'java' THEN 'Java' WHEN 'cs' THEN 'C#' END"

SQL = {
    "a03_languages": f"SELECT {_EXT} AS by_path, count(*) AS n, count(*) FILTER (programming_language <> {_EXT}) AS n_other FROM files GROUP BY 1",
    "a04_not_excluded": "SELECT file_id FROM files WHERE NOT regexp_matches('/' || short_path, '/vendor/|/node_modules/|^/tests/')",
    "a07_parse_errors": "SELECT regexp_replace(error, '[0-9]+', '#', 'g') AS error, count(DISTINCT file_id) AS n_files FROM (SELECT file_id, unnest(errors) AS error FROM files) GROUP BY 1",
    "a08_git_log": "SELECT repo, hash, coalesce(author, '') AS author, ts, coalesce(email, '') AS email, CAST(sum(coalesce(len(list_filter(files, lambda x: trim(x) <> '')), 0)) AS BIGINT) AS n FROM commit_log GROUP BY repo, hash, coalesce(author, ''), ts, coalesce(email, '')",
    "a15_modules": """WITH f AS (SELECT file_id, repo, short_path, regexp_replace(short_path, '/?[^/]*$', '') AS folder FROM files), m AS (SELECT DISTINCT repo, folder AS root FROM f WHERE split_part(short_path, '/', -1) = 'go.mod'),
        j AS (SELECT file_id, arg_max(root, length(root)) AS root, any_value(f.repo) AS repo FROM f JOIN m ON m.repo = f.repo AND (root = '' OR folder = root OR starts_with(folder, root || '/')) GROUP BY 1) SELECT f.file_id, root, j.repo || ':' || root AS module FROM f LEFT JOIN j ON j.file_id = f.file_id""",
    "a14_messages": "SELECT file_id, coalesce(path, '') AS path, coalesce(short_path, '') AS short_path, coalesce(programming_language, '') AS programming_language, coalesce(checksum, '') AS checksum, coalesce(is_test, false) AS is_test, coalesce(list_filter(errors, lambda x: x IS NOT NULL), []) AS errors, coalesce(loc, 0) AS loc, coalesce(lloc, 0) AS lloc, coalesce(cloc, 0) AS cloc FROM files",
    "c08_line_count": "SELECT file_id, CAST(len(string_split(source_text, chr(10))) AS INTEGER) AS loc FROM files WHERE source_text IS NOT NULL",
    "c10_distinct_units": "SELECT file_id, item_name, min(item_id) AS item_id FROM metrics WHERE kind = 'class' AND item_name IS NOT NULL GROUP BY 1, 2",
    "c12_functions_outside": "SELECT item_id FROM metrics f WHERE kind = 'function' AND item_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM metrics c WHERE c.kind = 'class' AND c.file_id = f.file_id AND c.item_name = split_part(f.item_name, '.', 1))",
    "j01_union_distinct": "SELECT repo, src, dst FROM edges UNION SELECT repo, dst, src FROM edges",
    "c14_reduced_namespaces": "SELECT DISTINCT src, CASE WHEN len(string_split(src, '.')) <= 1 THEN src ELSE split_part(src, '.', 1) END AS one, CASE WHEN len(string_split(src, '.')) <= 2 THEN src ELSE split_part(src, '.', 1) || '.' || split_part(src, '.', 2) END AS two FROM edges WHERE src IS NOT NULL",
    "c17_test_files": "SELECT file_id FROM (SELECT *, split_part(short_path, '/', -1) AS name FROM files) WHERE CASE WHEN programming_language = 'Golang' THEN ends_with(name, '_test.go') WHEN programming_language = 'Python' THEN regexp_matches(name, '^test_.*\\.py$|_test\\.py$') WHEN programming_language = 'TypeScript' THEN regexp_matches(name, '\\.(test|spec)\\.[cm]?[jt]sx?$') OR contains(short_path, '__tests__/') WHEN programming_language IN ('PHP', 'Java', 'C#') THEN regexp_matches(name, 'Tests?\\.(php|java|cs)$') WHEN programming_language = 'Rust' THEN regexp_matches(name, '_test\\.rs$') OR contains(short_path, '/tests/') ELSE false END",
    "c21_file_loc": "SELECT f.file_id, CAST(coalesce(nullif(lloc, 0), s, 0) AS BIGINT) AS lloc, coalesce(cloc, 0) AS cloc FROM files f LEFT JOIN (SELECT file_id, sum(greatest(coalesce(loc, 1), 1)) AS s FROM metrics WHERE kind = 'function' GROUP BY 1) k ON k.file_id = f.file_id",
    "b02_json": "SELECT item_id, path, cyclomatic_complexity, round(CASE WHEN isnan(maintainability_index) THEN 0.0 ELSE maintainability_index END, 6) AS mi, loc FROM metrics WHERE kind = 'file'",
    "b03_open_metrics": f"""WITH {MEASURED}, g AS (SELECT f.path, CAST(max(cyclomatic_complexity) FILTER (kind = 'file') AS DOUBLE) AS c, any_value(f.loc)::DOUBLE AS l, any_value(f.lloc)::DOUBLE AS ll, any_value(f.cloc)::DOUBLE AS cl, max(maintainability_index) FILTER (kind = 'file') AS mi, max(h_volume) FILTER (kind = 'file') AS v, count(*) FILTER (kind = 'function')::DOUBLE AS nf, count(*) FILTER (kind = 'class')::DOUBLE AS nc, max(afferent) FILTER (kind = 'file')::DOUBLE AS ca, max(efferent) FILTER (kind = 'file')::DOUBLE AS ce
            FROM measured m JOIN files f ON f.file_id = m.file_id WHERE f.file_id IN (SELECT file_id FROM metrics WHERE kind = 'file') GROUP BY f.file_id, f.path),
        w AS (SELECT *, CASE WHEN v > 0 THEN CASE WHEN l + ll + cl = 0 THEN 0.0 WHEN ll > 0 THEN greatest(0.0, (171 - 5.2 * ln(v) - 0.23 * c - 16.2 * ln(ll)) * 100 / 171) ELSE 0.0 END END AS woc FROM g),
        n AS (SELECT path, unnest([{', '.join(f"'{x}'" for x in B.GAUGES)}]) AS gauge, unnest([c, l, ll, cl, mi, woc, nf, nc, ca, ce]) AS x FROM w)
        SELECT gauge, gauge || '{{path="' || path || '"}} ' || CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(round(x, 6) AS VARCHAR) END AS line FROM n WHERE x IS NOT NULL
        UNION ALL {' UNION ALL '.join(f"SELECT '{g}', '# HELP {g} {h}' UNION ALL SELECT '{g}', '# TYPE {g} gauge'" for g, h in B.GAUGES.items())}""",
    "b04_sarif": f"WITH {_LINT}, r AS (SELECT rule, row_number() OVER (ORDER BY f0, l0, rule) - 1 AS rule_index FROM (SELECT rule, min(file_id) AS f0, arg_min(CAST(trunc(value) AS INTEGER), (file_id, CAST(trunc(value) AS INTEGER))) AS l0 FROM v GROUP BY 1)) SELECT v.rule, CAST(rule_index AS INTEGER) AS rule_index, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'warning' END AS level, file_id AS file, greatest(CAST(trunc(value) AS INTEGER), 1) AS line, sha256(v.rule || chr(0) || file_id || chr(0) || CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR)) AS fingerprint FROM v JOIN r ON r.rule = v.rule",
    "b08_folder_dependencies": "SELECT regexp_replace(src, '\\.?[^.]*$', '') AS src_folder, regexp_replace(dst, '\\.?[^.]*$', '') AS dst_folder, count(*) AS n, count(DISTINCT src) AS n_packages FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2",
    "b09_scopes": "SELECT '1-all' AS kind, 'all' AS name, count(*) AS n FROM files UNION ALL SELECT '2-language', coalesce(programming_language, ''), count(*) FROM files GROUP BY programming_language UNION ALL SELECT '3-directory', split_part(short_path, '/', 1), count(*) FROM files GROUP BY 2",
    "b12_chart": "SELECT src, min(dst) AS first_dst, count(DISTINCT dst) AS n_relations FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src",
    "o01_stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "b10_dictionary": "SELECT src AS src_name, dst AS dst_name, count(*) AS n FROM edges GROUP BY 1, 2",
    "b11_pruned_files": "SELECT file_id, short_path, programming_language, loc, is_test FROM files",
}
