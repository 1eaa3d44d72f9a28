"""Core operators on small tables: nulls, ties, repeated rows, empty tables, clashing names."""

import gzip
import json
import re
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeweft.operators import extract, graph, lint, review
from codeweft.operators.activity import author_touches, bus_factor, top_committers
from codeweft.operators.rollups import rollup
from codeweft.operators.skew import cell_join, heavy_keys, hot_cold_join, tree_aggregate
from codeweft.plans.graph import n05_get_dependencies
from codeweft.sinks import reports
from codeweft.sources import files as S
from codeweft.sources import models
from codeweft.sources.git import find_root, parse_log
from codeweft.streaming.activity import run_to_end, windowed_activity


def test_tree_aggregate_equals_group_by(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("__chunk"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 100).cast("string")).alias("k"))
    got = tree_aggregate(df, ["k"], {"n": ("sum", F.col("n")), "rows": ("sum", F.lit(1)), "top": ("max", F.col("n"))}, 20_000, chunk_rows=500, fan_in=3)
    want = df.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("top"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "n", "rows", "top").collect()))


def test_tree_aggregate_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, None), ("a", None)], "k string, x int")
    got = {r.k: r.s for r in tree_aggregate(df, ["k"], {"s": ("sum", F.col("x"))}, 3, chunk_rows=1, fan_in=2).collect()}
    assert got == {None: 1, "a": None}
    assert tree_aggregate(df.limit(0), ["k"], {"s": ("sum", F.col("x"))}, 0).count() == 0


def test_heavy_keys_share(spark):
    rows = [("a",)] * 4 + [("",)] * 50 + [(None,)] * 43 + [("b",)] * 3
    got = {r.key_value for r in heavy_keys(spark.createDataFrame(rows, "k string"), "k", 0.03).collect()}
    assert got == {"a", "b"}
    assert heavy_keys(spark.createDataFrame([], "k string"), "k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_cold_join(spark, how):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), ("x", 2)], "k string, v int")
    right = spark.createDataFrame([("h", 50, "H"), ("c", 1, "C")], "k string, w bigint, name string")
    got = sorted(map(tuple, hot_cold_join(left, right, ["k"], "w", 52, share=0.1, how=how).select("k", "v", "name").collect()))
    want = sorted(map(tuple, left.join(right, "k", how).select("k", "v", "name").collect()), key=lambda t: (t[0], t[1]))
    assert got == want


def test_cell_join_equals_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(40)] + [("h", 7), ("l", 1), ("l", 2), ("x", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("h", str(i)) for i in range(25)] + [("l", "a"), ("y", "b"), (None, "c")] + [("l", None)] * 9, "k string, w string")
    for task_rows in (20, 1_000_000):
        got = cell_join(left, right, "k", cell_rows=4, task_rows=task_rows)
        assert got.columns == ["k", "v", "w"]
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k").select("k", "v", "w").collect()))
    most = max(got.groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r["count"])["count"]
    assert most < 41 * 25  # the hot key's pairs lie in more than one task
    assert cell_join(left.limit(0), right, "k").count() == 0


def test_get_dependencies_of_a_hub_without_a_shuffle_of_the_result(spark, tmp_path):
    starts, hub = [f"a.ledger{i}" for i in range(60)], [("hub", f"p{i}") for i in range(400)]
    edges = [(s, "hub") for s in starts] + hub + hub[:5] + [("hub", starts[0]), ("p1", starts[1]), (starts[2], starts[3]), (starts[3], starts[2]), (starts[4], starts[4]), (None, starts[5]), (starts[5], None)]
    spark.createDataFrame([("r", s, d, 1) for s, d in edges], "repo string, src string, dst string, weight bigint").write.parquet(f"{tmp_path}/edges.parquet")
    n = Counter((s, d) for s, d in edges if s and d and s != d)
    want = {(s, a, b, k) for (a, b), k in n.items() for s in starts if a == s or (s, a) in n or b == s}
    got = n05_get_dependencies(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not re.search("Exchange|Aggregate", plan[: plan.index("Join")])


def test_bus_factor_golden(spark):
    def factor(*authors):
        t = author_touches(spark.createDataFrame([(a,) for a in authors], "author string"))
        return [r.bus_factor for r in bus_factor(t).collect()], [(r.author, r.touches, round(r.percentage, 2)) for r in top_committers(t).orderBy("rank").collect()]

    assert factor("author1") == ([1], [("author1", 1, 100.0)])
    assert factor("author1", "author2", "author1") == ([1], [("author1", 2, 66.67), ("author2", 1, 33.33)])
    assert factor("author1", "noreply@github.com", "", None) == ([1], [("author1", 1, 100.0)])


def test_rollup_ignores_nan_and_zero_minimum(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", float("nan")), ("b", None)], "s string, x double")
    r = {row.s: row for row in rollup(df, ["x"], ["s"]).collect()}
    assert (r["a"].x_min, r["a"].x_count, r["b"].x_count, r[None].n, r[None].x_sum) == (2.0, 2, 0, 4, 2.0)


def test_graph_algorithms(spark):
    pdf = pd.DataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], columns=["src", "dst"])
    comp = graph.components_and_levels(pdf)
    assert comp["a"][0] == comp["b"][0] == comp["c"][0] == "a" and comp["d"] == ("d", 1) and comp["e"] == ("e", 2)
    b = graph.betweenness(pdf)
    assert b["d"] == pytest.approx(0.5) and b["e"] == 0
    assert sorted(graph.bandwidth_order(pdf)) == list("abcde")
    e = spark.createDataFrame(pdf).unionAll(spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string")).withColumn("repo", F.lit("r"))
    assert graph.density(e).first().density == pytest.approx(2 * 5 / 20)
    assert graph.label_communities(e, "repo").count() == 5
    got = {(r.node, r.depth) for r in graph.reach(e, spark.createDataFrame([("a",)], "start string"), 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_lcom4(spark):
    t = spark.createDataFrame([(1, "useA", "a"), (1, "useB", "b"), (2, "x", "a"), (2, "y", "a"), (3, "z", None)], "class_id int, method string, attribute string")
    assert {r.class_id: r.lcom4 for r in graph.lcom4(t).collect()} == {1: 2, 2: 1, 3: 1}


def test_lint_registry(spark):
    f = spark.createDataFrame([("f1", "s", 25, 10), ("f1", "t", None, 400)], "file_id string, subject string, ccn int, loc int")
    rules = lint.threshold_rules({"cyclomatic_complexity": 20, "max_loc": 150})
    assert {(r.rule, r.subject) for r in lint.evaluate({"file": f}, rules).collect()} == {("cyclomatic_complexity", "s"), ("max_loc", "t")}
    assert lint.parse_severity("[High] too long") == ("high", "too long") and lint.parse_severity("plain") == ("unknown", "plain")


@pytest.mark.parametrize("before, after, want", [(8, 15, ("complexity-regression", "medium")), (5, 16, ("complexity-regression", "high")), (None, 26, ("new-complex-function", "high")), (20, 15, ("complexity-improvement", "low")), (5, 6, None)])
def test_review_findings(spark, before, after, want):
    head = spark.createDataFrame([("Pay", after)], "subject string, ccn int")
    base = spark.createDataFrame([("Pay", before)] if before is not None else [], "subject string, ccn int")
    got = [(r.kind, r.severity) for r in review.function_findings(head, base).collect()]
    assert got == ([want] if want else [])


def test_file_changes(spark):
    head = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, checksum string")
    base = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "path string, checksum string")
    assert {(r.path, r.status) for r in review.file_changes(head, base).collect()} == {("b", "changed"), ("c", "deleted"), ("d", "added")}


def test_line_counts():
    assert extract.line_counts(["return a // b"], False, True, False)[2] == 0 and extract.line_counts(["return a // b # c"], True, True, True)[2] == 1
    assert extract.line_counts(["/* a", "b", "*/", "", "x = 1", 's = "// no"'])[2] == 3
    assert extract.blank_quotes("'test'") == "      "


def test_extract_units(spark):
    go = 'package a\nimport "x"\ntype Cart struct {\n}\nfunc (c *Cart) Add(a int, b int) int {\n\tif a > 1 {\n\t\tfor i := 0; i < b; i++ {\n\t\t}\n\t} else if b > 2 {\n\t}\n\treturn a\n}\n'
    py = "import os\nclass C:\n    def m(self, x):\n        if x:\n            pass\n        elif x > 1:\n            pass\n        for i in x:\n            pass\n        while x:\n            x = 0\n"
    rows = [("f1", "Golang", go), ("f2", "Python", py), ("f3", "Python", "def ("), ("f4", "Java", None), ("f5", "Java", "")]
    got = extract.extract_units(spark.createDataFrame(rows, "file_id string, programming_language string, source_text string")).collect()
    fn = {r.name: r for r in got if r.kind == "function"}
    assert (fn["Add"].n_if, fn["Add"].n_elseif, fn["Add"].n_loop, fn["Add"].n_parameters) == (1, 1, 1, 2)
    assert (fn["m"].n_if, fn["m"].n_elseif, fn["m"].n_loop, fn["m"].owner) == (1, 1, 2, "C")
    assert [r.name for r in got if r.file_id == "f3"] == ["Parse error"] and {r.name for r in got if r.kind == "class"} == {"C", "Cart"}


def test_scan_and_excludes(spark, tmp_path):
    for name in ("src/a.py", "src/vendor/b.py", "src/c.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    got = {(r.short_path, r.language) for r in S.scan(spark, str(tmp_path)).collect()}
    assert got == {("src/a.py", "Python"), ("src/c.txt", None)}


def test_git_log_parser(spark):
    log = "# abc|Ann|100|a@x\na.go\nb.go\n\n# def|Bob|x|b@x\nc.go\n"
    rows = parse_log(spark.createDataFrame([("r", log), ("e", "")], "repo string, log string")).collect()
    assert [(r.hash, r.ts, r.file) for r in rows] == [("abc", 100, "a.go"), ("abc", 100, "b.go"), ("def", None, "c.go")]
    assert find_root("/nonexistent/folder") is None


def test_models(spark, tmp_path):
    w = tmp_path / "v.bin"
    w.write_bytes(b"W2V1" + struct.pack("<II", 2, 1) + struct.pack("<H", 2) + b"ab" + np.array([1, 2], "<f4").tobytes())
    vectors, dim = models.read_vectors(str(w))
    assert dim == 2 and vectors["ab"].tolist() == [1, 2]
    forest = {"classes": ["x", "y"], "trees": [{"feature": [0, -1, -1], "threshold": [1.5, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [[0, 0], [3, 1], [0, 4]]}]}
    (tmp_path / "m.gz").write_bytes(gzip.compress(json.dumps(forest).encode()))
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, a double")
    got = {r.id: [(p.label, p.probability) for p in r.predictions] for r in models.predict(df, models.read_forest(str(tmp_path / "m.gz")), "id", ["a"]).collect()}
    assert got == {1: [("x", 0.75), ("y", 0.25)], 2: [("y", 1.0)]}
    (tmp_path / "codeweft.json").write_text('{"sources": ["a"], "odd": 1}')
    assert models.load_config(str(tmp_path)) == ({"sources": ["a"], "odd": 1}, ["unknown key: odd"])


def test_reports(spark):
    v = spark.createDataFrame([("r2", "high", "f", 0), ("r1", "odd", "g", 7)], "rule string, severity string, file string, line int")
    got = {r.rule: (r.rule_index, r.level, r.line) for r in reports.sarif_results(v).collect()}
    assert got == {"r2": (0, "error", 1), "r1": (1, "warning", 7)}  # in the order first seen, by file
    doc = json.loads(reports.sarif_document(reports.sarif_results(v)).first().sarif)
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 2
    lines = [r.line for r in reports.open_metrics(spark.createDataFrame([("a", 1.0, None)], "p string, x double, y double"), "p", ["x", "y"]).collect()]
    assert lines[0] == 'x{path="a"} 1' and sorted(lines[1:]) == ["# HELP x x", "# HELP y y", "# TYPE x gauge", "# TYPE y gauge"]
    assert "| a |" in reports.markdown_table([{"a": 1}])


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    got = sorted((r.event_type, r.n, r.total) for r in run_to_end(windowed_activity(stream), "t_windows").collect())
    assert got == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_levels_take_light_edges_and_lone_communities(spark, tmp_path):
    from codeweft.plans.graph import k13_levels

    # a heavy way a -> b -> c, closed by one light edge; d is known by an inner edge only
    rows = [("x.a", "x.b")] * 5 + [("x.b", "x.c")] * 5 + [("x.c", "x.a"), ("x.c", "x.e"), ("p.d", "q.d")]
    spark.createDataFrame([("r", a, b, 1) for a, b in rows], "repo string, src string, dst string, weight bigint").write.parquet(str(tmp_path / "edges.parquet"))
    got = {r.community: (r.component, r.level) for r in k13_levels(spark, str(tmp_path)).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 0), "c": ("a", 0), "e": ("e", 1), "d": ("d", 0)}


def test_top_paths_run_to_their_end(spark):
    chain = [("s", "n1", 1)] + [(f"n{i}", f"n{i + 1}", 1) for i in range(1, 9)] + [("t", f"m{i:02d}", 1) for i in range(25)] + [("u", "v", 999), ("u", "w", 1), ("v", "u2", 1), ("u2", "v", 1)]
    links = spark.createDataFrame(chain, "src string, dst string, weight bigint")
    nodes = spark.createDataFrame([(x,) for a, b, _ in chain for x in (a, b)] + [("lone",)], "node string")
    got = {(r.start, r.path): (r.p, r.place) for r in graph.top_paths(links, nodes).collect()}
    want = {("s", "s>" + ">".join(f"n{i}" for i in range(1, 8))): (1.0, 1), ("u", "u>w"): (0.001, 1), ("lone", "lone"): (1.0, 1)}
    assert got == want | {("t", f"t>m{i:02d}"): (0.04, i + 1) for i in range(5)}


def test_slice_prealloc_needs_an_append_in_a_bounded_loop(spark):
    from codeweft.plans.quality import _APPEND, _BOUNDED_FOR

    loop = "for (i := 0; i < len(items); i++) {\n\t\tresult = append(result, items[i])\n\t}"
    rows = [(1, f"package main\n\nfunc main() {{\n\tvar result []int\n\t{loop}\n\t{loop}\n}}"), (2, "for (i := 0; i < n; i++) {\n\tx += i\n}\ny = append(y, 1)"), (3, "for {\n\tk := a % b\n}"), (4, None), (5, "")]
    got = lint.slice_prealloc(spark.createDataFrame(rows, "file_id int, source_text string"), _BOUNDED_FOR, _APPEND).collect()
    assert [(r.file_id, r.n) for r in got] == [(1, 2)]


def test_file_dependencies_resolve_by_namespace_then_class_name(spark):
    units = spark.createDataFrame([
        ("f1", "class", "Ledger", None, None, "App.Model.Ledger"), ("f2", "class", "Token", None, None, "Token"), ("f3", "class", "Ledger", None, None, "Other.Ledger"), ("g1", "class", "Other", None, None, "Other"),
        ("f2", "dependency", "Ledger", "Token", "App\\Model\\Ledger", None), ("f2", "dependency", "Token", None, "x.y.Token", None), ("f1", "dependency", "Token", None, "x.y.Token", None), ("f1", "dependency", "Other", None, "a.Other", None), ("f1", "dependency", "Ledger", None, "Other.Ledger", None),
    ], "file_id string, kind string, name string, owner string, namespace string, qualified string")
    files = spark.createDataFrame([("f1", "r"), ("f2", "r"), ("f3", "r"), ("g1", "s")], "file_id string, repo string")
    got = sorted(map(tuple, extract.file_dependencies(units, files).where("direction = 'efferent'").select("file_id", "other").collect()))
    assert got == [("f1", "f2"), ("f1", "f3"), ("f2", "f1")]
    assert extract.file_dependencies(units, files).where("direction = 'afferent'").count() == 3
    resolved = {(r.file_id, r.namespace): r.to_class for r in extract.resolve_dependencies(units, files).collect()}
    assert resolved["f1", "a.Other"] is None and resolved["f2", "App\\Model\\Ledger"] == "Ledger"
