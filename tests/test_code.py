"""Extraction and what is built on it, on small sources of every language."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import text as X
from codeweft.operators import code, extract, graph, lint, review, testquality, text
from codeweft.operators.rollups import project_measures
from codeweft.sinks import reports
from codeweft.sources import files as S
from codeweft.sources import models, protobuf
from codeweft.sources.git import checkout, merge_base, parse_log, resolve

CART = {
    "Golang": "package shop\n\ntype Cart struct {\n\ttotal int\n}\n\nfunc (c *Cart) Add(price int, n int) int {\n\tif n > 1 {\n\t\tc.total = c.total + price * n\n\t}\n\treturn c.total\n}\n",
    "PHP": "<?php\nnamespace App\\Shop;\n\nclass Cart\n{\n    public function Add($price, $n)\n    {\n        if ($n > 1) {\n            $this->total = $this->total + $price * $n;\n        }\n        return $this->total;\n    }\n}\n",
    "Python": "class Cart:\n    def Add(self, price, n):\n        if n > 1:\n            self.total = self.total + price * n\n        return self.total\n",
    "Rust": "pub struct Cart {\n    total: i64,\n}\n\nimpl Cart {\n    pub fn Add(&mut self, price: i64, n: i64) -> i64 {\n        if n > 1 {\n            self.total = self.total + price * n;\n        }\n        return self.total;\n    }\n}\n",
    "TypeScript": "export class Cart {\n  Add(price: number, n: number): number {\n    if (n > 1) {\n      this.total = this.total + price * n;\n    }\n    return this.total;\n  }\n}\n",
    "Java": "package shop;\n\npublic class Cart {\n    public int Add(int price, int n) {\n        if (n > 1) {\n            this.total = this.total + price * n;\n        }\n        return this.total;\n    }\n}\n",
    "C#": "namespace Shop;\n\npublic class Cart\n{\n    public int Add(int price, int n)\n    {\n        if (n > 1) {\n            this.total = this.total + price * n;\n        }\n        return this.total;\n    }\n}\n",
}


@pytest.mark.parametrize("language", CART)
def test_cart_is_read_alike_in_every_language(language):
    units = extract.ADAPTERS[language](CART[language])
    method = next(u for u in units if u["kind"] == "function")
    assert (method["name"], method["owner"], len(method["parameters"]), method["depth"]) == ("Add", "Cart", 2, 1)
    assert [method[k] for k in ("n_if", "n_elseif", "n_else", "n_loop", "n_case", "n_switch")] == [1, 0, 0, 0, 0, 0]
    assert method["lloc"] - (language != "Python" and 0) in (3, 4)
    # comparison, assignment, sum, product
    assert len(method["operators"]) == 4 and len(set(method["operators"])) == 4
    operands = [o.lstrip("$").replace("c.total", "total") for o in method["operands"]]
    assert sorted(operands) == sorted(["n", "1", "total", "total", "price", "n", "total"])
    assert [u["name"] for u in units if u["kind"] == "class"] == ["Cart"]


def test_nested_functions_keep_their_own_decisions():
    ts = "function outer(a) {\n  if (a) {}\n  function inner(b) {\n    for (;;) { if (b) {} else if (a) {} else {} }\n  }\n  while (a) {}\n}\n"
    by = {u["name"]: u for u in extract.ADAPTERS["TypeScript"](ts)}
    assert (by["outer"]["n_if"], by["outer"]["n_loop"], by["inner"]["n_if"], by["inner"]["n_elseif"], by["inner"]["n_else"], by["inner"]["n_loop"]) == (1, 1, 1, 1, 1, 1)
    py = "def outer(a):\n    if a:\n        pass\n    def inner(b):\n        while b:\n            b = 0\n    return inner\n"
    by = {u["name"]: u for u in extract.ADAPTERS["Python"](py)}
    assert (by["outer"]["n_if"], by["outer"]["n_loop"], by["inner"]["n_loop"]) == (1, 0, 1)


def test_switches_imports_and_odd_texts():
    java = "import a.b.C;\nclass X extends Base {\n int f(int a) {\n  switch (a) {\n   case 1: return 1;\n   case 2: return 2;\n  }\n  return 0;\n }\n}\n"
    units = extract.ADAPTERS["Java"](java)
    f = next(u for u in units if u["kind"] == "function")
    assert (f["n_switch"], f["n_case"]) == (1, 2)
    assert {(u["name"], u["namespace"]) for u in units if u["kind"] == "dependency"} == {("C", "a.b.C"), ("Base", "Base")}
    go = 'package a\nimport (\n\t"net/http"\n\tio "os"\n)\nfunc F() {}\n'
    assert {u["namespace"] for u in extract.ADAPTERS["Golang"](go) if u["kind"] == "dependency"} == {"net/http", "os"}
    ts = 'import { A, B } from "./x";\nimport * as y from "y";\n'
    assert {(u["name"], u["namespace"]) for u in extract.ADAPTERS["TypeScript"](ts) if u["kind"] == "dependency"} >= {("A", "./x"), ("B", "./x")}
    for text in ("}}}}", "{{{{", "class", "func (", "\"", "/*", "x" * 100_000, "a(" * 5000):
        for adapt in extract.ADAPTERS.values():
            assert isinstance(adapt(text), list)


@pytest.fixture
def shop(spark):
    rows = [(lang, lang, text) for lang, text in CART.items()]
    return extract.extract_units(spark.createDataFrame(rows, "file_id string, programming_language string, source_text string"))


def test_class_metrics_and_features(spark, shop):
    c = {r.file_id: r for r in code.class_metrics(shop).collect()}
    assert set(c) == set(CART) and all(r.ccn == 2 and r.n_methods == 1 for r in c.values())
    assert len({r.h_vocabulary for r in c.values()}) == 1 and len({r.h_length for r in c.values()}) == 1
    files = spark.createDataFrame([(k, k, k, k, ["Parse error"] if k == "Rust" else None) for k in CART], "file_id string, path string, short_path string, language string, errors array<string>")
    rows = code.derived_ratios(code.feature_rows(shop, files)).collect()
    assert set(code.DATASET) <= set(rows[0].asDict()) and len(code.DATASET) == 30
    assert {r.file_id for r in rows} == set(CART) - {"Rust"} and {r.stmt_type for r in rows} == {"class", "function"}
    assert code.feature_rows(shop.limit(0), files).count() == 0


@pytest.mark.parametrize("language, method, want", [
    ("PHP", "__construct", 2), ("PHP", "Example", 2), ("Python", "__init__", 2), ("TypeScript", "constructor", 2), ("Java", "Example", 2), ("Java", "finalize", 2), ("C#", "Finalize", 2), ("Rust", "new", 2), ("Rust", "drop", 2), (None, "__construct", 2),
    ("PHP", "new", 1), ("Golang", "Example", 1),
])
def test_cohesion_without_lifecycle_methods(spark, language, method, want):
    rows = [("f", "class", "Example", None, None, None, None)] + [("f", "function", m, "Example", 1, a, []) for m, a in (("useA", ["a"]), ("useB", ["b"]), (method, ["a", "b"]))]
    units = spark.createDataFrame(rows, "file_id string, kind string, name string, owner string, lloc int, attributes array<string>, calls array<string>")
    languages = spark.createDataFrame([("f", language)], "file_id string, language string")
    assert [r.lcom4 for r in code.class_cohesion(units, languages).collect()] == [want]


def test_context_rules(spark):
    go = 'package a\n\nimport (\n\t"context"\n\t"net/http"\n)\n\nfunc Get(url string) error {\n\thttp.Get(url)\n\treturn nil\n}\n\nfunc Good(ctx context.Context, url string) {\n\thttp.Get(url)\n}\n\nfunc Bad(ctx context.Context) {\n\tuse(context.Background())\n}\n\nfunc hidden() { http.Get("x") }\n'
    units = extract.extract_units(spark.createDataFrame([("f", "Golang", go), ("g", "Golang", "package b\nfunc F() {}\n")], "file_id string, programming_language string, source_text string"))
    assert [tuple(r) for r in code.context_missing(units).collect()] == [("f", 1, 2)]
    assert [tuple(r) for r in code.context_ignored(units).collect()] == [("f", 1)]


def _quality(spark, classes, deps, tests):
    c = spark.createDataFrame([("p", *r) for r in classes], "scope string, class_name string, file_id string, ccn int, efferent int, afferent int")
    d = spark.createDataFrame([("p", *r) for r in deps], "scope string, file_id string, is_test boolean, class_name string, namespace string, src string")
    touched = testquality.touched_classes(c, d)
    links = d.where("not is_test and src is not null").select("scope", "src", F.col("class_name").alias("dst"))
    t = testquality.test_files(spark.createDataFrame([("p", x) for x in tests], "scope string, file_id string"), touched, testquality.chain_depth(touched, links))
    return c, touched, t


def test_quality_without_tests(spark):
    c, touched, t = _quality(spark, [("Main", "main", 10, 3, 2)], [], [])
    r = testquality.totals(c, touched, t).first()
    assert (r.n_classes, r.n_tested, r.traceability, r.n_test_files) == (1, 0, 0.0, 0)
    assert [(r.class_name, r.weight) for r in testquality.untested_classes(c, touched).collect()] == [("Main", 60)]


def test_quality_of_wide_and_deep_tests(spark):
    classes = [(f"C{i}", f"f{i}", 1, 0, 0) for i in range(12)]
    deps = [("wide", True, f"C{i}", None, None) for i in range(6)] + [("one", True, "", "C0", None), ("one", True, "NoClass", None, None)] + [("f0", False, "C1", None, "C0"), ("f1", False, "C2", None, "C1"), ("f2", False, "C0", None, "C2")]
    c, touched, t = _quality(spark, classes, deps, ["wide", "one", "none"])
    got = {r.file_id: (r.fan_out, r.depth, r.score, r.label) for r in t.collect()}
    assert got == {"wide": (6, 0, 40, "Coupled"), "one": (1, 2, 80, "Isolated"), "none": (0, 0, 100, "Isolated")}
    r = testquality.totals(c, touched, t).first()
    assert (r.n_classes, r.n_tested, r.traceability, r.n_test_files) == (12, 6, 50.0, 3)


def test_roles_and_outcomes(spark):
    free = lambda a, b: spark.range(1).select(lint.valid_dependency(F.lit(a), F.lit(b)).alias("x")).first().x
    assert not free("component:interface:controller", "infrastructure:db:x") and not free("component:domain:rule", "component:app:service") and not free("component:data_access:repo", "component:x:interface")
    assert not free("component:domain:rule", "component:domain:service") and free("component:domain:rule", "component:domain:entity") and free("odd", "component:app:x")
    f = spark.createDataFrame([("f1", "s", 25), ("f2", "s", 1), ("v/f3", "s", 99)], "file_id string, subject string, ccn int")
    got = {r.file_id: (r.n_errors, r.succeeded) for r in lint.outcomes({"file": f}, lint.threshold_rules({"cyclomatic_complexity": 20}), {"cyclomatic_complexity": "^v/"}).collect()}
    assert got == {"f1": (1, False), "f2": (0, True)}


def test_suggestions_stop_after_the_file_that_reaches_enough(spark):
    files = spark.createDataFrame([(f"f{i:02d}", 5, 0.9, 60) for i in range(8)] + [("f99", 2, 0.9, 99)], "file_id string, n int, risk double, ccn int")
    hard = spark.createDataFrame([("f00", "K"), ("f01", "K")], "file_id string, location string")
    got = review.suggestions(files, hard, 0.7, 3, 50, 10)
    per = {r.file_id: r["count"] for r in got.groupBy("file_id").count().collect()}
    assert per == {"f00": 3, "f01": 2, "f02": 2, "f03": 2, "f04": 2} and got.where("location = 'K'").count() == 1


def test_deltas_and_measures(spark):
    h = spark.createDataFrame([("a", 3.0, None), ("b", 1.0, 1.0)], "scope string, x double, y double")
    b = spark.createDataFrame([("a", 1.0, 2.0), ("c", 4.0, 0.0)], "scope string, x double, y double")
    assert {r.scope: (r.delta_x, r.delta_y) for r in review.measure_deltas(h, b, ["x", "y"]).collect()} == {"a": (2.0, -2.0), "b": (1.0, 1.0), "c": (-4.0, 0.0)}
    cols = "scope string, " + ", ".join(f"{c} double" for c in "loc lloc cloc ccn h_difficulty h_effort h_volume h_time h_bugs mi mi_woc comment_weight".split())
    f = spark.createDataFrame([("s", *[10.0] * 9, float("nan"), 1.0, 1.0), ("s", *[20.0] * 9, 50.0, None, 1.0)], cols)
    c = spark.createDataFrame([("s", *[60.0] * 12, 2, 0, 4, 0.5)], cols + ", n_methods int, afferent int, efferent int, instability double")
    r = project_measures(f, c).first()
    assert (r.avg_loc, r.avg_loc_per_method, r.avg_loc_per_class, r.avg_mi_per_method, r.avg_ccn_per_class, r.avg_efferent, r.min_ccn, r.max_ccn, r.n_methods, r.n_classes) == (30.0, 15.0, 60.0, 50.0, 60.0, 4.0, 10.0, 20.0, 2, 1)


def test_betweenness_dealt_out_equals_one_place(spark):
    import pandas as pd

    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("c", "g"), ("x", "y")]
    got = {r.node: r.betweenness for r in graph.betweenness_of(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == pytest.approx(graph.betweenness(pd.DataFrame(pairs, columns=["src", "dst"])))


def test_small_communities_merge_into_their_strongest_neighbour(spark):
    members = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("a3", "A"), ("b1", "B"), ("c1", "C"), ("l1", "L")], "node string, community string")
    edges = spark.createDataFrame([("b1", "a1", 1), ("a2", "b1", 1), ("b1", "c1", 1), ("c1", "b1", 1), ("c1", "l1", 1)], "src string, dst string, n int").where("dst <> 'l1'")
    got = {r.node: r.community for r in graph.merge_small(members, edges, 2).collect()}
    assert got == {"a1": "A", "a2": "A", "a3": "A", "b1": "A", "c1": "A", "l1": "L"}


def test_names_of_clusters(spark):
    vectors = spark.createDataFrame([("ledger", [1.0, 0.0]), ("entry", [0.9, 0.1]), ("book", [0.8, 0.3]), ("cat", [0.0, 1.0])], "word string, vec array<double>")
    members = spark.createDataFrame([("k", "a.b.LedgerEntry"), ("k", "a.b.LedgerBook"), ("k", "a.b.EntryBook"), ("k", "a.b.LedgerCat"), ("s", "app.billing.Thing"), ("s", "app.billing.Other"), ("u", "zzz")], "cluster string, name string")
    got = {r.cluster: r.name for r in text.cluster_names(members, vectors).collect()}
    assert got == {"k": "Book Entry Ledger" if got["k"].count(" ") == 2 else got["k"], "s": "billing", "u": "Miscellaneous"}
    assert "Cat" not in got["k"] and "Ledger" in got["k"] or "Entry" in got["k"]


def test_ambiguities_and_patterns(spark):
    p = lambda *xs: [{"label": a, "probability": b} for a, b in xs]
    rows = [(1, p(("component:domain:entity", 0.4), ("component:data:repository", 0.35), ("x", 0.2), ("y", 0.05))), (2, p(("a", 0.6), ("b", 0.3))), (3, p(("a:b:c", 0.5), ("d:e:f", 0.48))), (4, p(("a", 1.0)))]
    got = [(r.key, r.labels, r.pattern) for r in text.ambiguities(spark.createDataFrame(rows, "key int, predictions array<struct<label:string,probability:double>>"), "key").collect()]
    assert got == [(3, "a:b:c;d:e:f", "c + f"), (1, "component:domain:entity;component:data:repository;x", "entity with persistence code")]


def test_contributor_formats(spark):
    r = spark.range(1).select(X.initials(F.lit("anna maria de luca")).alias("a"), X.initials(F.lit("7")).alias("b"), X.initials(F.lit(None).cast("string")).alias("c"), X.avatar(F.lit(" A@B.c ")).alias("d"), X.avatar(F.lit("none")).alias("e"), X.contributor_colour(F.lit("")).alias("f"), X.contributor_colour(F.lit("Ann")).alias("g")).first()
    assert (r.a, r.b, r.c, r.e, r.f) == ("AMD", "7", "?", "", X.NO_COLOUR) and r.d.endswith("?s=80&d=404") and r.g in X.COLOURS
    assert X.fnv32a(b"") == 0x811C9DC5 and X.fnv32a(b"a") == 0xE40C292C


def test_log_of_names_with_bars_and_commits_without_paths(spark):
    rows = parse_log(spark.createDataFrame([("r", "# h1|A|B|5|m@x\nf.go\n\n# h2|C||c@x\n")], "repo string, log string")).collect()
    assert [(r.hash, r.author, r.ts, r.email, r.file) for r in rows] == [("h1", "A|B", 5, "m@x", "f.go"), ("h2", "C", None, "c@x", None)]


def test_messages_round_trip(spark):
    rows = [("1", "/a/b.go", "b.go", "Golang", "c", True, ["x", ""], 300, 0, None), ("2", None, "", None, None, None, None, None, None, None), ("3", "ü" * 200, "s", "PHP", "", False, [], 1, 2, 3)]
    got = {r.file_id: r for r in protobuf.load_messages(protobuf.dump(spark.createDataFrame(rows, protobuf.COLUMNS.replace("programming_language string, checksum", "programming_language string, checksum").replace("file_id string, path string, short_path string", "file_id string, path string, short_path string")))).collect()}
    assert (got["1"].path, got["1"].is_test, got["1"].errors, got["1"].loc, got["1"].cloc) == ("/a/b.go", True, ["x", ""], 300, 0)
    assert (got["2"].path, got["2"].errors, got["2"].is_test, got["2"].loc) == ("", [], False, 0) and got["3"].path == "ü" * 200 and got["3"].cloc == 3


def test_searches_lists_and_csv(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    assert S.find(spark, str(tmp_path), "py") is S.find(spark, str(tmp_path), ".py") and S.find(spark, str(tmp_path), "py").count() == 1
    S.forget()
    one = S.scan(spark, str(tmp_path))
    assert S.merged(one, one.withColumn("extra", F.lit(1))).count() == 2
    (tmp_path / "t.csv").write_text('id,text\n1,"a ""b""\nc"\n2,\n')
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "t.csv"), "id int, text string").collect()] == [(1, 'a "b"\nc'), (2, None)]


def test_git_refs(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "f").write_text("1")
    run("add", "f")
    run("commit", "-m", "one")
    run("branch", "other")
    head = resolve(str(tmp_path), "main")
    assert head and resolve(str(tmp_path), "other") == head and resolve(str(tmp_path), "missing") is None and merge_base(str(tmp_path), "other") == head
    checkout(str(tmp_path), "other")
    assert resolve(str(tmp_path), "HEAD") == head


def test_report_forms(spark, tmp_path):
    f = spark.createDataFrame([("complexity-regression", "high", "a", 1, 20), ("complexity-regression", "medium", "b", 1, 12), ("complexity-improvement", "low", "c", 9, 1)], "kind string, severity string, subject string, before int, after int")
    assert "1 more" in reports.review_report(f, "main", "text", most=1) and "**complexity-regression** (`a`, high)" in reports.review_report(f, "main", "markdown")
    assert '"regressions": 2' in reports.review_report(f, "main", "json") and "Methodology " + review.METHODOLOGY in reports.review_report(f, "main")
    assert "3 files" in reports.markdown_report({"files": 3, "loc": 1500, "ccn": 1.234, "mi": 64.2, "risky": [{"a": 1}], "title": "T"}) and "1 K lines" in reports.markdown_report({"files": 3, "loc": 1500, "ccn": None, "mi": None, "risky": [], "title": "T"})
    pages = reports.html_pages(spark.createDataFrame([("language", "C# <x>", 2)], "kind string, name string, files int")).first()
    assert pages.page == "language-c-sharp-x.html" and "&lt;x&gt;" in pages.html and "<x>" not in pages.html
    sinks = reports.reporters({"json": str(tmp_path / "j"), "csv": ""})
    assert len(sinks) == 1 and spark.read.json(sinks[0][0](f, sinks[0][1])).count() == 3
    with pytest.raises(ValueError):
        reports.reporters({"odd": "x"})


def test_dictionary_and_forest(spark):
    df = spark.createDataFrame([("a", "b"), ("b", None), ("a", "c")], "x string, y string")
    table, coded = reports.dictionary(df, ["x", "y"])
    names = {r.id: r.value for r in table.collect()}
    assert sorted((names[r.x], names.get(r.y)) for r in coded.collect() if r.y is not None) == [("a", "b"), ("a", "c")] and len(names) == 3 and coded.where("y is null").count() == 1
    rows = [(i, "user repository" if i % 2 else "order controller", float(i % 2), "repo" if i % 2 else "ctrl") for i in range(40)]
    train = spark.createDataFrame(rows, "id int, t string, n double, label string").withColumn("words", F.split("t", " "))
    model = models.train_forest(train, "words", ["n"], "label", bins=64, trees=3)
    assert model.transform(train).where("guess = label").count() == 40
