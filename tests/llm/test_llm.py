"""Operators of the llm sub-package on small fixtures: brute force, round trips, held-out accuracy, odd input."""

import base64
import itertools
import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from codeweft.llm import bpe, handwritten, leaks, names, ranking, splits, syntax, truncation
from codeweft.llm.cooccurrence import commit_items, pair_counts


# p1 ---------------------------------------------------------------------------------------------------------------

AUTHORS = [
    (1, "Eleanor Pelvol", "epelvol@fern.example"), (2, "Eleanor PÃ©lvÃ³l", "EPELVOL@FERN.EXAMPLE"), (3, "eleanorpelvol", None), (4, "Ellie Pelvol", None), (5, "Pelvol, E.", "epelvol+git@fern.example"),
    (6, "Elenaor Pelvol", ""), (7, "ep", "epelvol@fern.example"), (8, "E. Pelvol", "123+epelvol@users.noreply.forge.example"),
    (10, "Harold Pelvol", "hpelvol@fern.example"), (11, "Jobra Engineering Inc", "dev@jobra.example"), (12, "jobra eng.", None), (13, "Jobra Foundation Ltd", "dev@jobra.example"),
    (14, "root", "root@host1.invalid"), (15, "root", "root@host2.invalid"), (16, None, None), (17, "", ""), (18, "Ann Xolan", "dev@shared.example"), (19, "Bob Zulan", "dev@shared.example"),
]


def test_p1_links_variants(spark):
    df = spark.createDataFrame(AUTHORS, "identity_id bigint, author string, email string").withColumn("key", F.lit(1)).withColumn("form", F.lit("x"))
    commits = spark.createDataFrame([("Eleanor Pelvol", "epelvol@fern.example")] * 5 + [(None, None)], "author string, email string")
    got = {(r.identity_a, r.identity_b) for r in names.same_entity_pairs(names.link_authors(df, commits)).collect()}
    eleanor = [1, 2, 3, 4, 5, 6, 7, 8]
    assert got == set(itertools.combinations(eleanor, 2)) | {(11, 12)}


def test_p1_every_form_of_a_block_is_a_candidate(spark, monkeypatch):
    rows = [
        (1, "Alexander Smith", "1+x@users.noreply.forge.example"), (2, "Alexandra Smith", "alexandrasmith@fern.example"), (3, "Alexandr Smith", None),
        # two typos, so that only the personal mailbox brings them together; a stranger at it stays away
        (4, "Eleanor Pelvolan", "ep@fern.example"), (5, "Elenor Pelvoln", "ep@fern.example"), (6, "Harold Zulan", "ep@fern.example"),
    ]
    df = spark.createDataFrame(rows, "identity_id bigint, author string, email string")
    commits = spark.createDataFrame([("Alexander Smith", "1+x@users.noreply.forge.example")] * 300, "author string, email string")
    for hot in (1000, 1):
        monkeypatch.setattr(names, "HOT_BLOCK", hot)
        got = {(r.identity_a, r.identity_b) for r in names.same_entity_pairs(names.link_authors(df, commits)).collect()}
        assert got == {(1, 3), (4, 5)}


def test_p1_empty(spark):
    df = spark.createDataFrame([], "identity_id bigint, author string, email string")
    assert names.same_entity_pairs(names.link_authors(df)).count() == 0


@pytest.mark.parametrize("raw, want", [("PÃ©lvÃ³l", "pelvol"), ("Pélvöl", "pelvol"), ("Straße", "strasse"), ("plain", "plain")])
def test_p1_fold(raw, want):
    assert names.fold(raw) == want


# p3 ---------------------------------------------------------------------------------------------------------------

def test_p3_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5, rng.random()]), rng.choice([None, 1, 1, 1, 2, 9])) for i in range(200)]
    rows += rows[:5] + [(500, None, None), (None, 3.0, 4)]
    df = spark.createDataFrame(rows, "item_id bigint, a double, b int").withColumn("rank", F.lit(7)).withColumn("score", F.lit("x"))
    got = {r.item_id: r for r in ranking.median_rank(df, scores={"a": (1, 1.0), "b": (-1, 2.0)}).collect()}
    worst = {}
    for i, a, b in rows:
        if i is not None:
            w = worst.setdefault(i, {})
            if a is not None and not math.isnan(a):
                w["a"] = max(w.get("a", -1e9), a + 0.0)
            if b is not None:
                w["b"] = max(w.get("b", -1e9), -float(b))
    ranks = defaultdict(list)
    for s, weight in (("a", 1.0), ("b", 2.0)):
        values = [w[s] for w in worst.values() if s in w]
        for i, w in worst.items():
            if s in w:
                ranks[i].append(((sum(v > w[s] for v in values) + (sum(v == w[s] for v in values) + 1) / 2) / len(values), weight))
    def median(rs):
        rs = sorted(rs)
        half, upto, low, high = sum(w for _, w in rs) / 2, 0.0, None, None
        for r, w in rs:
            upto += w
            low = r if low is None and upto >= half else low
            high = r if high is None and upto > half else high
        return (low + high) / 2
    want = {i: (round(median(ranks[i]), 9), round(sum(r * w for r, w in ranks[i]) / sum(w for _, w in ranks[i]), 9)) if ranks[i] else (None, None) for i in worst}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.median_rank, r.mean_rank) == (None, None) if want[i][0] is None else (r.median_rank, r.mean_rank) == pytest.approx(want[i], abs=2e-9)
    order = sorted(want, key=lambda i: (want[i][0] is None, want[i][0] or 0, want[i][1] or 0, i))
    assert sorted(got, key=lambda i: got[i].position) == order and sorted(r.position for r in got.values()) == list(range(1, len(want) + 1))


def test_p3_empty(spark):
    assert ranking.median_rank(spark.createDataFrame([], "item_id bigint, a double"), scores={"a": (1, 1.0)}).count() == 0


# p4 ---------------------------------------------------------------------------------------------------------------

def _samples(spark, rows):
    return spark.createDataFrame(rows, "sample_id bigint, class_name string, file_path string, programming_language string, label string").withColumn("label_hot", F.lit(1)).withColumn("node", F.lit(2))


def test_p4_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "Util", f"A.B{rng.randint(0, 60)}"]), rng.choice([None, f"r/src/F{rng.randint(0, 60)}.go", "r/src/hot.go"]), "Go", rng.choice("xy")) for i in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, c, f, lang, _ in rows:
        find(i)
        if f:
            parent[find(i)] = find(("f", f))
        if c and "." in c:
            parent[find(i)] = find(("c", c))
    groups = defaultdict(list)
    for r in rows:
        groups[find(r[0])].append(r[0])
    want = {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}
    got = {tuple(r) for r in splits.members_of_groups(splits.sample_groups(_samples(spark, rows)), "sample_id").collect()}
    assert got == want


def test_p4_spellings_and_chain(spark):
    rows = [(1, "\\A\\B1", "r/src/a.php", "PHP", "x"), (2, " A\\B1 ", "r/src/b.php", "php", "x"), (3, "A.B1", "/builds/r//./src/c.ts", "TS", None), (4, None, "r\\src\\c.ts ", "TypeScript", "y"), (5, "B1", None, "PHP", "y"), (6, None, None, None, None)]
    got = {r.sample_id: r.group_id for r in splits.sample_groups(_samples(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    chain = [(i, f"C.K{i // 2}", f"r/src/f{(i + 1) // 2}.go", "Go", "x") for i in range(1, 40)]
    assert {r.group_id for r in splits.sample_groups(_samples(spark, chain)).collect()} == {1}


def test_p4_splits_keep_groups_and_shares(spark):
    rows = [(i, None, f"r/src/f{i // 3}.go", "Go", "x" if i % 4 else "y") for i in range(3000)]
    s = _samples(spark, rows)
    placed = splits.assign_splits(s, splits.sample_groups(s), "sample_id", F.col("label")).collect()
    by_group = defaultdict(set)
    for r in placed:
        by_group[r.group_id].add(r.split)
    assert len(placed) == 3000 and all(len(v) == 1 for v in by_group.values())
    n = Counter(r.split for r in placed)
    assert abs(n["train"] - 2400) < 60 and abs(n["test"] - 300) < 40 and abs(n["validation"] - 300) < 40


def test_p4_empty(spark):
    s = _samples(spark, [])
    groups = splits.sample_groups(s)
    assert splits.members_of_groups(groups, "sample_id").count() == 0
    assert splits.assign_splits(s, groups, "sample_id", F.col("label")).count() == 0


# p5 ---------------------------------------------------------------------------------------------------------------

GOOD = {
    "a.go": "package a\n\nimport (\n\t\"log\"\n\t\"a/b\"\n)\n\ntype T struct {\n\tx int\n}\n\n// it's } odd\nfunc (t *T) F(a int, b []string) (int, error) {\n\tif a > 1 && b != nil {\n\t\treturn a * (a - 1), nil\n\t} else if a < 0 {\n\t\tfor i := range b {\n\t\t\tlog.Println(\"<<<<<<< x }\", i)\n\t\t}\n\t}\n\treturn -a, nil\n}\n",
    "a.php": "<html><?php\n\nnamespace A\\B;\n\nuse A\\C\\D;\n\nclass X extends Y implements Z\n{\n    private ?int $n = null;\n    public function f(int $a, $b = [1, 2]): ?int\n    {\n        # it's fine {\n        foreach ($b as $k => $v) {\n            $this->log(\"x {$v}\" . 'y');\n        }\n        return $a ?? -1;\n    }\n}\n",
    "a.py": "#!/usr/bin/env python\nimport os\nfrom a.b import (c,\n    d)\n\nclass A(B, metaclass=M):\n    \"\"\"<<<<<<< not a } mark\"\"\"\n\n    @deco(1)\n    def f(self, *a, k: int = 3, **kw) -> dict:\n        if not a and k in (1, 2):\n            return {x: y for x, y in kw.items()}\n        elif k is None:\n            pass\n        else:\n            raise ValueError(f\"{k!r}\") from None\n        with open(k) as fh, x as y:\n            lambda: 0\n        return a[1:-1]\n",
    "a.rs": "use crate::a::{B, C};\nuse std::fmt::*;\n\n#[derive(Debug, Clone)]\npub struct S<'a> {\n    x: &'a str,\n}\n\nimpl<'a> S<'a> {\n    pub fn f(&self, a: i64, c: char) -> Option<i64> {\n        let mut v = vec![1, 2];\n        for i in 0..9 {\n            v.push(i);\n        }\n        match c {\n            'a' => Some(1),\n            _ => None,\n        }\n    }\n}\n",
    "a.ts": "import { A } from \"./a\";\nimport type { B } from './b'\n\nexport class X<T> extends Y {\n  private readonly m: Map<string, number> = new Map();\n  f(a: number, b?: string): number {\n    const g = (x: number) => x * 2;\n    let r = a > 1 ? `it's ${a}` : /[\"'}]/g.test(b!);\n    for (let i = 0; i < 3; i++) { if (i) continue; }\n    return this.m.get(b as string) ?? -1;\n  }\n}\n",
    "a.js": "/*! x */!function(t,e){if(!j.b)throw Error(\"j\");function q(a,b){return a?b.w:-1};t.m=function(v){for(var g=0;g<v.length;g++)t.v(v[g])};e[\"m\"]=u&&f||null}(this,{});",
    "a.java": "package a.b;\n\nimport a.C;\nimport static a.D.*;\n\n@Anno(x = {1, 2})\npublic class X<T extends Y> implements Z {\n    private final int[] a = {1, 2};\n    /* it's } */\n    public <U> int f(int a, String... s) throws E {\n        for (int i = 0; i < 3; i++) {\n            a += (int) s[i].length();\n        }\n        Runnable r = () -> { log.info(\"closing '}'\"); };\n        return a > 0 ? -1 : this.g(X::new);\n    }\n}\n",
    "a.cs": "#region x\nusing System;\nusing A.B;\n\nnamespace A.C;\n\npublic class X : Y\n{\n    public int P { get; set; }\n    public int F(int a, out string s)\n    {\n        s = $\"x {a}\" + @\"c:\\d\";\n        var q = a > 1 ? new List<int> { 1, 2 } : null;\n        foreach (var i in q) { Log.Info(\"it's\", i); }\n        return a;\n    }\n}\n#endregion\n",
}


#: Constructs beyond the common ones, all valid.
WIDE={
"x.go":"package a\n\nvar (\n\tx = map[string]int{\"a\": 1, \"b\": 2}\n\ty []byte\n)\n\nconst K = 1 << 10\n\ntype I interface {\n\tF(a int) error\n}\n\nfunc G[T any](xs ...T) {\n\tgo func() { <-ch }()\n\tselect {\n\tcase v, ok := <-ch:\n\t\t_ = v\n\tdefault:\n\t}\n\tswitch x := y.(type) {\n\tcase int:\n\t\treturn\n\t}\n\tp := &T{a: 1}\n\t*p = 2\n\tfor {\n\t\tbreak\n\t}\n\tdefer f.Close()\n\tch <- 1\n\tx[i]++\n\treturn x[1:], nil\n}\n",
"x.rs":"//! doc\nuse a::b as c;\npub mod x;\nconst N: usize = 3;\nstatic S: &'static str = r#\"a \"q\" b\"#;\ntype R<T> = Result<T, Box<dyn Error>>;\npub trait Tr { fn a(&self) -> i32; fn b() {} }\npub enum E { A(i32), B { x: u8 }, C = 3 }\nimpl<T: Clone + 'static> Tr for S<T> where T: Ord {\n    async fn go(mut self) -> R<()> {\n        let Some(x) = y else { return Ok(()); };\n        if let Some(v) = x.get(0) && v > &1 { *v += 1; }\n        let f = |a, b| a + b;\n        let t = (1, 2.5e3, 'x', b'\\n', \"s\\\"q\");\n        println!(\"{}\", t.0);\n        loop { break; }\n        while let Some(_) = it.next() {}\n        foo::<u8>(1)?.await?;\n        let a = [0; 10];\n        let r = &a[..2];\n        match x { 1 | 2 => {}, n if n > 3 => (), _ => unreachable!() }\n        unsafe { *p }\n    }\n}\n#[cfg(test)]\nmod tests {\n    use super::*;\n    #[test]\n    fn t() { assert_eq!(1, 1); }\n}\n",
"x.ts":"#!/usr/bin/env node\nimport * as fs from 'fs';\nimport d, { e as f } from \"g\";\nexport * from './x';\nexport default class {}\ninterface A { a?: number; [k: string]: any; f(): void }\ntype U = 'a' | 'b' | null;\nenum E { A = 1, B }\ndeclare global { var x: number }\nasync function* g<T extends U>(this: A, ...r: T[]): AsyncIterable<T> { yield* r; await x; }\nconst { a, b: [c, , d2] = [] } = o ?? {};\nlet v = a?.b?.[0]?.(1) as unknown as string;\nif (typeof v === 'string' && !v) { delete o.x } else if (v in o) throw new Error(`e ${v + `n`}`);\nfor (const k of Object.keys(o)) { continue }\nlabel: while (true) { break label }\nswitch (v) { case 'a': case \"b\": x++; break; default: }\nconst h = function () { return { ...o, [k]: 1, get y() { return 1 } } };\ntry { f() } catch { } finally { }\nabstract class Q<T = {}> implements A { static #p = 1; constructor(private a: number) { super() } abstract m(): void; get z(): number { return -1 } }\nx = y ? -1 : +2;\nlet re = /a[/]b/gi, z = a / b / c;\nexport { v, h as default };\nlet n = 1_000n, hex = 0xFF;\n",
"x.py":"from __future__ import annotations\nimport a.b as c, d\nx: int = 1; y = 2\nasync def f(a, /, b, *, c=1, **k) -> None:\n    async with a as b, c:\n        pass\n    async for i in x: print(i)\n    await g()\n    return\nclass A: pass\nz = [i for i in range(3) if i % 2 == 0]\nt = (yield)\nd = {**a, 'b': 1}\nprint(*x, sep='')\nif (n := len(x)) > 1: pass\nelse: pass\ntry:\n    1/0\nexcept (A, B) as e:\n    raise\nfinally:\n    del x[0], y\nwhile not x: break\nmatch x:\n    case [1, *_]:\n        pass\n    case {'a': b} if b:\n        pass\ns = r'\\d' \"b\" f'{x!r:>{w}}' b'x'\nl = lambda *a, k=1: -a[0]\nx = y = 3\nx @= y ** -2 // 3\nq = a if b else c\nassert x, 'm'\nglobal g\nt = 1,\nx = not a\ny = x[...,None][::2]\nfoo(\n    a,\n  b)\n@d.e(f)\ndef h(): ...\nw = 'a' \\\n    'b'\ndef k():\n    '''doc'''\n    x = 1 if y else 2\n    return x is not None and x not in z\n",
"x.java":"/** d */\npackage a;\nimport java.util.*;\npublic abstract sealed class A<T extends B & C> extends D<T> implements E, F permits G {\n  @Override\n  public static void main(final String[] args) throws X, Y {\n    int[][] m = new int[3][];\n    List<Map<String, Integer>> l = new ArrayList<>();\n    for (String s : args) if (s instanceof String t && !t.isEmpty()) continue;\n    switch (x) { case 1: case 2: break; default: y(); }\n    var r = switch (k) { case A, B -> 1; default -> { yield 2; } };\n    do { x--; } while (x > 0);\n    try (var in = open()) { } catch (X | Y e) { throw e; } finally { }\n    Function<Integer, Integer> f = (a) -> a + 1;\n    char c = '\\'';\n    synchronized (this) { assert x > 0 : \"m\"; }\n    label: while (true) break label;\n    x = (y) ? 1.5f : 0x1F;\n    String s = \"\"\"\n      a \"q\" b\n      \"\"\";\n    this.<T>foo(A.class, int[].class, String::valueOf);\n    int a = 1, b = 2;\n    b >>>= 2; b <<= 1;\n  }\n  enum Z { A(1) { }, B; Z(int... i) { } }\n  @interface Q { int v() default 1; }\n  record P(int x, int y) { P { } }\n  { init(); }\n  static { }\n  A() { super(); }\n  <U> U g(U u) { return (U) u; }\n}\n",
"x.cs":"// c\nusing System;\nusing static System.Math;\nusing A = B.C;\nglobal using X;\n[assembly: Foo(\"x\")]\nnamespace N { \n  [Serializable]\n  public abstract partial class A<T> : B<T>, IC where T : class, new()\n  {\n    private readonly int? _x = null;\n    public string P { get; private set; } = \"a\";\n    public int Q => _x ?? 0;\n    public event EventHandler E;\n    public A(int x) : base(x) { }\n    ~A() { }\n    public static A<T> operator +(A<T> a, A<T> b) => a;\n    public async Task<int> F(ref int a, params object[] o)\n    {\n      if (o is string s && s.Length > 0) return 1;\n      foreach (var (k, v) in d) { continue; }\n      using (var f = Open()) { }\n      using var g = Open();\n      var t = from i in l where i > 1 orderby i select i * 2;\n      switch (a) { case 1: break; case int n when n > 2: break; default: goto case 1; }\n      var r = a switch { 1 => \"x\", _ => throw new E() };\n      try { } catch (E e) when (e.X) { throw; } finally { }\n      await foreach (var x in y) { }\n      lock (this) { a++; }\n      var s2 = @\"a \"\"q\"\" b\" + $\"{a:N2} {b}\";\n      Func<int, int> h = x => x + 1;\n      int[] arr = { 1, 2 };\n      var an = new { A = 1, B = 2 };\n      d[\"k\"] = default;\n      string? q = a?.B?[0];\n      do { } while (a < 1);\n      return await Task.FromResult(typeof(int) == null ? -1 : +2);\n    }\n    public int this[int i] { get { return 1; } set { } }\n    enum Z : byte { A = 1, B }\n    record R(int X);\n    delegate void D(int x);\n  }\n}\n",
"x.php":"<?php\ndeclare(strict_types=1);\nnamespace A;\nuse B\\{C, D as E};\nuse function F\\g;\ninterface I extends J {}\ntrait T { protected static $x = []; abstract public function a(): void; }\nenum S: string { case A = 'a'; const B = self::A; }\nfinal class X extends Y implements I, K\n{\n    use T, U { a as private b; }\n    public const Z = 1;\n    public function __construct(private readonly int $a = 1, ?array &...$r) { parent::__construct(); }\n    #[Pure]\n    public static function make(int|string $x): static { return new static($x); }\n}\n$f = fn($x) => $x ** 2;\n$g = function () use (&$f): void { echo \"a {$f(1)} $b[0]\", PHP_EOL; };\nforeach ([1, 2] as $k => [$a, $b]): endforeach;\nfor ($i = 0, $j = 1; $i < 3; $i++, $j--) { if (!isset($a['b'])) continue; elseif ($x instanceof X) break; else die('x'); }\n$v = $a?->b ?? $c ?: @$d['e'];\nswitch ($x) { case 1: default: }\n$m = match(true) { $a > 1, $b => 'x', default => throw new E() };\ntry { } catch (A|B $e) { } finally { }\n$s = <<<EOT\n  it's \"x\" {$a}\nEOT;\n$o = new class(1) extends X { };\nlist('a' => $q) = $arr; $$n = (int) $z . 'a' . 1.5; $x .= 'b';\nstatic fn() => 1; $y = &$z; unset($a, $b); return -$x;\n?>\n<p><?= $x ?></p>\n",
}


@pytest.mark.parametrize("path", sorted(WIDE))
def test_p5_wide_grammar(path):
    assert problems(WIDE[path], syntax.GRAMMARS[path.rsplit(".", 1)[1]]) == []


@pytest.mark.parametrize("path", sorted(GOOD))
def test_p5_valid_and_broken(path):
    grammar = syntax.GRAMMARS[path.rsplit(".", 1)[1]]
    assert problems(GOOD[path], grammar) == []
    text = GOOD[path]
    broken = [text + "\n<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", text.replace(")", "", 1), text.replace("\"", "", 1), text[: len(text) // 2] + "\x00" + text[len(text) // 2 :], "# title\n\nHow to prune a window:\n\n1. open the window\n\n* 43 rows per call\n"]
    if path != "a.php":  # any text without tags is valid PHP
        broken.append("#!/bin/sh\nset -eu\nfor f in $(ls x/*.csv); do\n  echo \"a $f\" >&2\ndone\n")
    else:
        broken = broken[:-1]
    for b in broken:
        assert b == text or problems(b, grammar), b[:80]


def problems(text, grammar):
    out, stack, before = [x for _, x in _problems(text, grammar)], [], None
    for kind, a, b, _ in syntax.rows_of(text, grammar):
        if kind in "plsce":
            continue
        if kind == "b":
            for c in a:
                if c in "([{":
                    stack.append(c)
                elif not stack or "([{".index(stack.pop()) != ")]}".index(c):
                    out.append("nest")
        else:
            w = int(a)
            if before and (before[1] == "1") != (w > before[0]) and (before[1] == "1" or w > before[0]):
                out.append("indent")
            before = (w, b)
    return out + ["open"] * bool(stack)


def test_p5_spark_and_odd_rows(spark):
    rows = [(p, f"/x/{p}", t) for p, t in GOOD.items()] + [("bad1", "a.go", GOOD["a.go"][:-3]), ("bad2", "a.py", "def f():\nx = 1\n"), ("bad3", "b.java", "class A { void f() { g(1; } }"), ("bad4", "c.rs", "fn f() { a[0) }"), ("n", "a.go", None), ("e", "a.go", ""), ("o", "a.txt", "((("), (None, "a.go", "((("), ("p", None, "x")]
    rows += [("long", "a.go", "package a\n" + "// x\n" * 20000), ("longbad", "a.go", "package a\nfunc f() {\n" + "a()\n" * 20000)]
    df = spark.createDataFrame(rows, "file_id string, path string, source_text string").withColumn("short_path", F.lit(None).cast("string")).withColumn("kind", F.lit("b")).withColumn("sign", F.lit(1))
    assert {r.file_id for r in syntax.broken_files(df).collect()} == {"bad1", "bad2", "bad3", "bad4", "longbad"}
    assert syntax.broken_files(df.limit(0)).count() == 0


# p6 ---------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path, text, want", [
    ("src/a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n", "generation notice"), ("src/a.py", "# Dieser Code wurde von x erzeugt. Bitte nicht bearbeiten.\nx = 1\n", "generation notice"),
    ("tools/codegen/a.ts", "// Writes the header 'do not edit' into every file it emits.\nlet a = 1;\n", None), ("src/a.cs", "// Copyright (c) our own team. Hand-tuned, edit with care.\nclass A {}\n", None),
    ("src/a.cs", "// Reads generated files and merges them.\nclass A {}\n", None), ("lib/x/mosslex_util.py", "# mosslex v1.2.3 | (c) the mosslex contributors | MIT\nx = 1\n", "third-party notice"),
    ("node_modules/x/lib/x_io.ts", "let a = 1;\n", "vendored path"), ("vendor/foo/foo_io.go", "package foo\n", "vendored path"), ("app/Vendor/a.go", "package a\n", None), ("app/vendor_portal/vendor_a.go", "package a\n", None),
    ("lib/foo-1.2.3/src/foo_io.rs", "fn a() {}\n", "vendored path"), ("static/a.min.js", "x", "minified name"), ("a/package-lock.json", "{}", "lockfile"), ("gen/a_pb2.py", "x = 1\n", "generated name"),
    ("src/d.py", "X = [\n" + "    12345, 23456, 34567, 45678, 56789, 67890, 78901,\n" * 20 + "]\n", "data"), ("src/m.ts", "!function(t){" + "var a=1;if(!b)return c;function q(){return d};" * 30 + "}()", "minified"),
    ("src/s.go", "package s\n" + "".join(f"func (c *S) SetField{i:03d}(a int) int {{\n\treturn a\n}}\n" for i in range(12)), "numbered members"), ("src/n.go", None, None), (None, "package a\n", None), ("src/e.go", "", None),
])
def test_p6_single_files(path, text, want):
    assert handwritten._judge(path, text)[0] == want


def test_p6_copies_and_odd_rows(spark):
    body = "package x\n\nfunc F(a int) int {\n\treturn a + 1\n}\n\nfunc G(b int) int {\n\treturn b * 2\n}\n" * 2
    rows = [("v", "r1", "vendor/foo/foo_io.go", body), ("c", "r2", "core/sub/foo_io.go", "// note\n\n" + body.replace("\t", "    ")), ("o", "r2", "core/own.go", "package own\nfunc H() {}\n"), ("n", None, None, None), ("e", "r", "a.go", ""), (None, "r", "b.go", "package b\n")]
    df = spark.createDataFrame(rows, "file_id string, repo string, short_path string, source_text string").withColumn("path", F.col("short_path")).withColumn("programming_language", F.lit("Golang")).withColumn("n", F.lit(1)).withColumn("digest", F.lit("x"))
    got = {r.file_id: r.reason for r in handwritten.judge_files(df).collect()}
    assert got == {"v": "vendored path", "c": "copy of a third-party file", "o": None, "n": None, "e": None, None: None}
    assert handwritten.judge_files(df.limit(0)).count() == 0


# p7 ---------------------------------------------------------------------------------------------------------------

def test_p7_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for h in range(300):
        files = rng.sample([f"f{i}" for i in range(12)], rng.randint(0, 4)) + (["x", "y"] if h % 25 == 0 else [])
        rows.append(("r", f"h{h}", (files * 2 + [None]) if rng.random() < 0.5 else files))
    rows += rows[:40] + [("r", "null", None), (None, "q", ["a", "b"]), ("r", None, ["a", "b"]), ("r", "wide", [f"w{i}" for i in range(300)])]
    log = spark.createDataFrame(rows, "repo string, hash string, files array<string>").withColumn("n", F.lit(1)).withColumn("file", F.lit("z"))
    items = commit_items(log)
    got = {(r.file_a, r.file_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in pair_counts(items, items.count(), min_lift=2.0, block=3).collect()}
    sets = {h: {f for f in fs or [] if f} for repo, h, fs in rows if repo and h}
    sets = {h: s for h, s in sets.items() if s}
    single = Counter(f for s in sets.values() for f in s)
    pairs = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    want = {p: (k, single[p[0]], single[p[1]], len(sets)) for p, k in pairs.items() if k >= 4 and k * len(sets) >= 2 * single[p[0]] * single[p[1]]}
    assert got == want and want
    assert pair_counts(commit_items(log.limit(0)), 0).count() == 0


def test_p7_all_pairs_holds_rare_and_hot_pairs(spark, tmp_path):
    from codeweft.llm.plans.code import p7_all_pairs

    log = [("r", f"h{i}", ["a", "b"]) for i in range(6)] + [("r", "h9", ["a", "c", "c"]), ("r", "h9", ["a", "c"]), ("s", "h9", ["a", None])]
    spark.createDataFrame(log, "repo string, hash string, files array<string>").write.parquet(str(tmp_path / "commit_log.parquet"))
    got = {(r.file_a, r.file_b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in p7_all_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (6, 7, 6, 7, 1.0), ("a", "c"): (1, 7, 1, 7, 1.0)}


# p8 ---------------------------------------------------------------------------------------------------------------

def test_p8_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(bpe.VOCABULARY):
        pytest.skip("no vocabulary here")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    want = tiktoken.Encoding("own", pat_str=bpe.PIECES.pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [None, "", " ", "<|endoftext|> x", "a" * 3000, " " * 700, "ab" * 900, "héllo wörld 漢字 👩‍💻\r\n\tx", "it's we'll"] + ["".join(rng.choice("abcdefgh éü漢\n .'") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "again")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()]
    assert sorted(got, key=str) == sorted([(i, None if t is None else want.encode_ordinary(t)) for i, t in enumerate(texts)] + [(0, None)], key=str)
    assert bpe.encode_documents(df.limit(0)).count() == 0


# p9 ---------------------------------------------------------------------------------------------------------------

_RNG = random.Random(11)
_WORDS = ["".join(_RNG.choice("bcdfghklmnprstv") + _RNG.choice("aeiou") for _ in range(3)) for _ in range(400)]
OPENING = "read the following text with care and choose the option that follows from it alone without outside knowledge"
ITEMS = [(i, OPENING + ". " + " ".join(_RNG.choice(_WORDS) for _ in range(45)) + ".") for i in range(1, 9)]


def _quote(i, start, size):
    return leaks.words_of(dict(ITEMS)[i])[start : start + size]


def test_p9_passages(spark):
    filler = " ".join("the quick tool keeps returning a stale row".split() * 4)
    full, short = _quote(1, 20, 24), _quote(2, 25, 19)
    replaced = list(full)
    for k in (5, 11, 17):
        replaced[k] = "other"
    worse = list(full)
    for k in range(2, 24, 4):
        worse[k] = "other"
    docs = [
        (1, f"{filler} {' '.join(full)} {filler}"), (2, f"{filler} {' '.join(short)}"), (3, OPENING.upper() + " " + filler), (4, " ".join(replaced)), (5, " ".join(worse)),
        (6, "<p>" + "</p>\n<p>".join(full).replace("a", "\u0430").upper() + "&nbsp;</p>"), (7, " ".join(full[:12]) + "\n\n" + filler + "\n\n" + " ".join(full[12:])), (8, None), (9, ""), (None, " ".join(full)),
        (10, "x " * 50000 + " ".join(full)), (1, f"{' '.join(full)}"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5)).withColumn("n_words", F.lit(0))
    items = spark.createDataFrame(ITEMS + [(99, None), (98, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, items).collect()}
    assert got == {(1, 1), (4, 1), (6, 1), (7, 1), (10, 1)}
    assert leaks.find_leaks(df.limit(0), items).count() == 0 and leaks.find_leaks(df, items.limit(0)).count() == 0


def test_p9_seeds_miss_nothing():
    index = leaks.LeakIndex(leaks.local_statistics(ITEMS))
    rng = random.Random(2)
    for _ in range(50):
        i = rng.randint(1, 8)
        words = ["zzz"] * rng.randint(0, 9) + _quote(i, rng.randint(18, 40), 8) + ["qqq"] * rng.randint(0, 5)
        coded = [index.ids.get(w, -1) for w in words]
        brute = {(n, p - q) for n, ws in enumerate(index.coded) for p in range(len(coded) - 3) for q in range(len(ws) - 3) if coded[p : p + 4] == ws[q : q + 4] and not any(index.shared[n][q : q + 4])}
        assert {(n, p - q) for n, ps in index.seeds(coded).items() for p, q in ps} == brute


def test_p9_interrupted_passages_with_replaced_words():
    """The limit of replaced words holds for both parts together, and one part needs no seed."""
    index = leaks.LeakIndex(leaks.local_statistics(ITEMS))
    quote, filler = _quote(1, 20, 24), "zzz yyy xxx".split() * 5
    missed = []
    for size, at, replaced in [(24, 11, (4, 9)), (20, 10, (3, 6)), (20, 10, (12, 15)), (24, 12, (3, 6, 9)), (24, 12, (14, 17, 20)), (24, 12, (11, 12)), (21, 10, (9, 10))]:
        words = [("other" if k in replaced else w) for k, w in enumerate(quote[:size])]
        if [i for i, n in index.passages(" ".join(words[:at] + filler + words[at:])) if n >= 20] != [1]:
            missed.append((size, at, replaced))
    assert missed == []
    # the inserted text starts with the word at which the passage goes on
    assert [i for i, _ in index.passages(" ".join(quote[:10] + [quote[10]] + filler + quote[10:20]))] == [1]
    # over the limit, and a short quote with a few words of the item elsewhere
    over = [("other" if k in (2, 5, 14, 17) else w) for k, w in enumerate(quote[:20])]
    assert index.passages(" ".join(over[:10] + filler + over[10:])) == []
    assert index.passages(" ".join(quote[:15] + filler + ["other", quote[17], "other"])) == []


# p10 --------------------------------------------------------------------------------------------------------------

def _texts(seed, n):
    rng = random.Random(seed)
    ends = ["", "", "", " Cheers", "\nHope that helps.", "\n\n```\nx = y + 1\nreturn x\n```", " https://docs.x.example/a/12"]
    base = ["The cache does not own the row, so it can't load it for you.", "You have to split the queue before the parser starts.", "Restart the worker and check the index again.", "Which version of the exporter do you use?"]
    return [" ".join(rng.choice(base) for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(n)]


def test_p10_held_out_cuts():
    model = truncation.TruncationModel.fit(_texts(1, 900), [None] * 900)
    rng = random.Random(4)
    whole = _texts(2, 300)
    cuts = [c for t in whole if (c := truncation.artificial_cut(t, rng))]
    hit = sum(model.score(t, None) > truncation.THRESHOLD for t in cuts) / len(cuts)
    wrong = sum(model.score(t, None) > truncation.THRESHOLD for t in whole) / len(whole)
    assert hit > 0.93 and wrong < 0.05


def test_p10_limits_and_odd_rows(spark):
    texts = _texts(3, 300)
    long = [(" ".join(_texts(i, 12)))[:200] for i in range(40)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(1000 + i, t, "lim") for i, t in enumerate(long)] + [(2000, None, "a"), (2001, "", None), (2002, "  \n", "a"), (None, "Fine.", None), (2003, "Word. " * 30000, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("gap", F.lit(1)).withColumn("limit", F.lit(2))
    limits = {r.source: (r.char_limit, r.byte_limit) for r in truncation.source_limits(truncation.text_sizes(df)).collect()}
    assert limits.get("lim") == (200, 200)
    got = truncation.truncation_scores(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2000].log_odds is None and not by[2001].truncated and not by[2002].truncated and not by[2003].truncated
    mid = [i for i, t in enumerate(long) if not t.rstrip().endswith((".", "?", "Cheers", "```")) and " " in t]
    assert sum(by[1000 + i].truncated for i in mid) >= 0.9 * len(mid)
    assert truncation.truncation_scores(df.limit(0)).count() == 0


# SQL --------------------------------------------------------------------------------------------------------------

def test_llm_sql(spark, data):
    from codeweft.llm.plans import PLANS

    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("metrics", "commit_log", "class_samples"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    queries = {n: q for p in PLANS for n, q in p.QUERIES.items()}
    sql = {n: q for p in PLANS for n, q in p.SQL.items()}
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        df = queries[name](spark, data)
        res = con.execute(text)
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        mine = Counter(tuple(round(r[c], 8) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())
        assert mine == Counter(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in res.fetchall()), name


def test_p9_statistics_equal_those_of_plain_python(spark):
    opening = "please read the text below and choose the one statement that follows from all of it"
    rows = [*ITEMS, *[(100 + i, f"{opening} number{i} lies behind the hill near river{i}") for i in range(5)], (200, None), (201, " ")]
    got = {r.item_id: r for r in leaks.item_statistics(spark.createDataFrame(rows, "item_id bigint, text string")).collect()}
    want = leaks.local_statistics(rows)
    assert set(got) == {i for i, *_ in want}
    for i, words, shared, bits in want:
        assert list(got[i].words) == words and list(got[i].shared) == shared
        assert list(got[i].bits) == pytest.approx(bits)
    assert sum(got[100].shared) == 16


def test_p9_equal_items_and_passes(spark):
    words = _quote(ITEMS[0][0], 20, 30)
    twins = [*ITEMS, (900, ITEMS[0][1]), (901, "an own opening " + " ".join(words[:26]) + " and another end of it")]
    docs = spark.createDataFrame([(1, "well " + " ".join(words[:25]) + " so"), (2, "nothing here"), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame(twins, "item_id bigint, text string")
    one = {tuple(r) for r in leaks.find_leaks(docs, items).collect()}
    assert {(d, i) for d, i, _ in one} == {(1, ITEMS[0][0]), (1, 900), (1, 901)}
    assert {tuple(r) for r in leaks.find_leaks(docs, items, pass_bytes=200).collect()} == one


def test_p10_limits_of_many_small_sources(spark):
    rows = [(s * 10 + i, ("word " * 40)[: 120 if i < 5 else 60 + i], f"s{s}") for s in range(2000) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limits = truncation.source_limits(truncation.text_sizes(df))
    assert limits.where("char_limit = 120 and byte_limit = 120").count() == 2000


@pytest.mark.parametrize("path, vendored", [
    ("vendor/github.com/pkg/errors/errors.go", True), ("vendor/symfony/console/Application.php", True), ("third_party/zlib/inflate.c", True), ("third_party/abseil/base.h", True), ("vendor/autoload.php", True),
    ("app/Vendor/TicketService.cs", False), ("vendor_portal/core/a.go", False), ("lib/parcel/Handler.java", False), ("packages/web/src/app.ts", False), ("docs/third_party.py", False), ("app/vendor/list.go", False),
])
def test_p6_paths(path, vendored):
    assert (handwritten.path_vendored(path) is not None) == vendored


@pytest.mark.parametrize("header, generated", [
    ("// Code generated by protoc. DO NOT EDIT.", True), ("# This file was automatically generated", True), ("// Classes generated from a.xsd, do not modify", True),
    ("// Detects files generated by protoc.", False), ("// Writes 'code generated by' and \"do not edit\" into its output", False), ("# This is not generated by a tool", False), ("// Checks whether a file was automatically generated", False),
])
def test_p6_notices_and_mentions(header, generated):
    assert handwritten.header_generated(header) == generated


def test_p6_evidence_in_other_files(spark):
    body = "func f{}() int {{\n\tx := {}\n\treturn x * 3 // some text that makes the body long enough to be compared with others\n}}\n"
    rows = [
        ("m1", "r1", "deps/alpha/LICENSE", "MIT licence text " * 8), ("m2", "r1", "deps/alpha/src/run.go", body.format(1, 1)), ("o1", "r1", "deps/beta/run.go", body.format(2, 2)),
        ("s1", "r1", "external/gamma/io/run.go", body.format(3, 3)), ("s2", "r2", "external/gamma/io/run.go", body.format(3, 3)), ("c1", "r3", "core/run.go", body.format(3, 3)), ("n1", "r3", None, None),
    ]
    df = spark.createDataFrame([(i, r, "Golang", p, p, t) for i, r, p, t in rows], "file_id string, repo string, programming_language string, path string, short_path string, source_text string")
    got = {r.file_id: r.reason for r in handwritten.judge_files(df).collect()}
    assert got["m2"] == "third-party folder" and got["s1"] == got["s2"] == "third-party folder" and got["c1"] == "copy of a third-party file"
    assert got["o1"] is None and got["n1"] is None and len(got) == len(rows)


def _problems(text, grammar):
    """What the operator's parts say of one text, bracket windows aside."""
    import re as _re

    from codeweft.llm.grammar import LEFT, LINE_REDUCTIONS, REDUCTIONS, adjacent

    pairs = adjacent(grammar)
    before, after = {a for a, b in pairs if b == ";"} | {"^", ";"}, {b for a, b in pairs if a == ";"} | {"$"}
    out = []
    for kind, a, _, _ in syntax.rows_of(text, grammar):
        if kind == "p":
            out += [(kind, a[i : i + 2]) for i in range(0, len(a), 2) if (a[i], a[i + 1]) not in pairs]
        elif kind == "l":
            out += [(kind, a[i : i + 2]) for i in range(0, len(a), 2) if (a[i], a[i + 1]) not in pairs and not (a[i] in before and a[i + 1] in after)]
        elif kind == "s":
            out += [(kind, x) for x in a.split("\n") if _re.search(syntax._BAD_STATEMENTS[grammar], x)]
        elif kind == "e":
            out.append((kind, a))
        elif kind == "c":
            for content in a.split("\n"):
                mode, left = content.split("|")
                for _ in range(len(left) + 1):
                    for pattern, short in LINE_REDUCTIONS if mode == "lines" else REDUCTIONS:
                        left = _re.sub(pattern, short, left)
                if not _re.fullmatch(LEFT[mode], left):
                    out.append((kind, content))
    return out


@pytest.mark.parametrize("grammar, text", [
    ("java", "class A { void f() { else { } } }"), ("java", "class A { void f() { for (;;) } }"), ("java", "class A { void f() { try { } } }"), ("java", "class A { void f() { foo()\n bar(); } }"), ("java", "class A { void f() { x = y\n z = w; } }"),
    ("java", "class A { int f() { foo() } }"), ("java", "class A { void f() { if (a) { } else if { } } }"),
    ("cs", "class A { void F() { Foo()\n Bar(); } }"), ("cs", "class A { void F() { else { } } }"), ("cs", "class A { void F() { do { } } }"),
    ("php", "<?php\nfunction f() { $this->a()\n $x = 1; }"), ("php", "<?php\nif ($a) { } catch (E $e) { }"), ("php", "<?php\nfunction f() { foo() }"),
    ("go", "package a\n\nfunc f() {\n\tx := 1\n\telse {\n\t}\n}\n"), ("go", "package a\n\nfunc f() {\n\tfor i := 0; i < 3 {\n\t}\n}\n"), ("go", "package a\n\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n"),
    ("python", "try:\n    a()\nb()\n"), ("python", "else:\n    a()\n"), ("python", "def f():\n    return return\n"), ("python", "if a:\n    b()\nexcept E:\n    c()\n"), ("python", "x = y *\n"),
    ("rust", "fn f() -> { }"), ("rust", "fn f() { match { } }"), ("rust", "fn f() { foo() let y = 1; }"), ("rust", "fn f() { x(); else { } }"),
    ("ts", "function f() { else { } }"), ("ts", "const a = b c;"), ("ts", "try { a() }\nb();"),
])
def test_p5_finds_what_no_production_allows(grammar, text):
    assert _problems(text, grammar)


@pytest.mark.parametrize("grammar, text", [
    ("java", "package a.b;\nimport static a.B.c;\nimport java.util.*;\n@Service(\"x\")\npublic class A<T extends B & C> extends D<T> implements E, F {\n private static final int[] X = {1, 2, 3};\n enum Z { A, B(2) { int f() { return 1; } }; int f() { return 0; } }\n"
     " @Override public <K> Map<String, List<K>> f(final int a, String... b) throws IOException, E2 {\n  int[][] m = new int[3][];\n  for (int i = 0, j = 1; i < 3; i++) { if (a > 1) continue; else if (b == null) break; else x(); }\n  for (String s : b) System.out.println((Object) s);\n"
     "  do { a--; } while (a > 0);\n  try (Reader r = open(); Reader q = r) { r.read(); } catch (A | B e) { throw new X(e); } finally { y(); }\n  switch (a) { case 1: case 2: return null; default: break; }\n  int k = switch (a) { case 1 -> 2; default -> { yield 3; } };\n"
     "  Runnable r = () -> { go(); };\n  list.stream().map(x -> x + 1).filter(A::ok).forEach((p, q) -> p.f(q));\n  Object o = new Object() { int z = 1; public String toString() { return \"\" + z; } };\n  label: while (true) { break label; }\n  int t = a > 1 ? b[0].length() : ~a >> 2;\n  assert a > 0 : \"m\";\n  synchronized (this) { n++; }\n  if (o instanceof String s && s.isEmpty()) return; \n  ;\n }\n record P(int x, int y) { }\n interface I { int f(); default void g() { } }\n static { init(); }\n}\n"),
    ("cs", "using System;\nusing X = System.IO.File;\nnamespace A.B\n{\n [Serializable, Obsolete(\"x\")]\n public sealed class C<T> : D, IE<T> where T : class, new()\n {\n  private readonly int[] _a = new[] { 1, 2 };\n  public string Name { get; private set; } = \"n\";\n  public int N => _a.Length;\n  public C(int x) : base(x) { }\n"
     "  public async Task<int> F(ref int a, params string[] b)\n  {\n   var q = from x in b where x != null orderby x select new { x, y = 1 };\n   foreach (var (k, v) in d) { if (k is string s && s.Length > 0) continue; else break; }\n   using (var r = Open()) { r.Read(); }\n   using var z = Open();\n   try { await G(); } catch (E e) when (e.X) { throw; } finally { H(); }\n"
     "   var o = new P { A = 1, B = { 2, 3 } };\n   int y = a switch { 1 => 2, > 3 and < 5 => 4, _ => 0 };\n   Func<int, int> f = x => x + 1;\n   lock (this) { _a[0]++; }\n   switch (a) { case 1: goto default; default: return 1; }\n   do { a--; } while (a > 0);\n   for (int i = 0; i < 3; i++) ;\n   x?.Foo()?.Bar[1]!.Baz();\n   int? n = null ?? 3;\n   return (int)y;\n  }\n"
     "  enum E { A = 1, B }\n  delegate void D(int x);\n  public static C operator +(C a, C b) { return a; }\n  public int this[int i] { get { return i; } set { } }\n }\n public record R(int X, string Y);\n}\n"),
    ("php", "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\nuse function G\\h;\n#[Attr(1)]\nfinal class X extends Y implements Z {\n use T { a as protected b; }\n const K = 1, L = 2;\n private ?int $x = null;\n public function __construct(private readonly string $a, int|string $b = 2, &...$c) { parent::__construct($a); }\n"
     " abstract protected static function f(): ?array;\n public function g() {\n  foreach ($this->a as $k => &$v) { if (!$v) continue; elseif ($k) break; else { $z[] = $v; } }\n  for ($i = 0, $n = 3; $i < $n; $i++) echo $i, \"x\";\n  try { f(); } catch (A | B $e) { throw new E($e); } finally { }\n  $h = function ($x) use (&$y) { return $x . $y; };\n  $m = match (true) { $a > 1, $b => 'x', default => 'y' };\n"
     "  $o = new class(1) extends Q { public $p = [1, 'a' => 2]; };\n  switch ($a) { case 1: return 1; default: break; }\n  list($a, , $b) = $c; [$d, $e] = f();\n  $s = <<<EOT\n text $x\nEOT;\n  return $a ?: $b ?? fn($x) => $x * 2;\n }\n}\nif ($a): ?> <b>x</b> <?php else: echo 1; endif;\n"),
    ("ts", "import A, { B as C, type D } from './a';\nimport * as E from \"e\";\nexport * from './f';\n@Comp({ a: 1 })\nexport default class X<T = {}> extends Y<T> implements Z {\n  @Input() name: string;\n  private readonly m = new Map<string, number[]>();\n  static #p = 1;\n  constructor(private a: A, public b?: B) { super(); }\n  get v(): number { return this.a!.x }\n  async *g(): AsyncGenerator<number> { yield* h() }\n  [key: string]: any\n}\n"
     "interface I { a: string; b?(x: number): void; readonly c: A | null }\ntype U = 'a' | `b` & { [K in keyof T]?: T[K] };\nenum E2 { A = 1, B }\nconst f = async ({ a, b: [c] = [], ...rest }: P): Promise<void> => { await x(); if (a) return; else throw new Error(`x ${a}`) };\nfor (const [k, v] of Object.entries(o)) { if (k in v) continue\n else break }\nfor (let i = 0, n = 3; i < n; ++i);\n"
     "try { a() } catch { b() } finally { c() }\nswitch (x) { case 1: { break } default: y() }\nlabel: while (true) break label\nconst r = /a[/]b/g.test(s) ? x?.y?.[0] : z ?? w\nlet o = { a, b() { return 1 }, get c() { return 2 }, [d]: 3, ...e, async f() {} }\ndo { i-- } while (i)\nvar fn = function* () {}, q = <any>x, t = x as unknown as T;\nexport { f as default, o };\ndeclare module 'm' { export function g(a: number): asserts a is 1; }\n"),
    ("go", "package a\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tf func(a int, b ...string) (int, error)\n}\n\ntype I interface {\n\tF(x int) error\n\t~int | ~string\n}\n\nconst (\n\tX = iota\n\tY\n)\n\nvar z = map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\n"
     "func (s *S[T]) M(a int, b ...string) (n int, err error) {\n\tdefer func() { recover() }()\n\tfor i := 0; i < 3; i++ {\n\t\tif x, ok := z[\"a\"]; ok && len(x) > 0 {\n\t\t\tcontinue\n\t\t} else if err != nil {\n\t\t\tbreak\n\t\t} else {\n\t\t\tgo f(i)\n\t\t}\n\t}\n\tfor k, v := range z {\n\t\t_ = k\n\t\tv[0]++\n\t}\n\tfor range ch {\n\t}\nouter:\n\tfor {\n\t\tbreak outer\n\t}\n"
     "\tswitch y := x.(type) {\n\tcase int, string:\n\t\treturn 1, nil\n\tdefault:\n\t\tfallthrough\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\tfmt.Println(v)\n\tcase ch <- 1:\n\t}\n\tp := &S[int]{\n\t\tA: 1,\n\t\tf: func(a int, b ...string) (int, error) { return a, nil },\n\t}\n\ta, b = b, a\n\tx.y[1:2:3], *q = -3, !c\n\treturn\n}\n"),
    ("rust", "#![allow(x)]\nuse std::{fmt::{self, Debug}, io::*};\nmod a;\n#[derive(Debug, Clone)]\npub struct S<'a, T: Debug + 'a> where T: Clone { pub(crate) a: &'a str, b: Vec<Option<T>> }\nstruct U(i32, pub u8);\npub enum E { A, B(i32), C { x: u8 }, D = 3 }\nimpl<'a, T> fmt::Display for S<'a, T> where T: Debug + Clone {\n    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, \"{}\", self.a) }\n}\n"
     "pub async fn g<F>(mut x: i32, f: F) -> Result<(), Box<dyn Error>> where F: Fn(i32) -> i32 {\n    let v: Vec<_> = (0..10).map(|i| i * 2).filter(|&x| x > 1).collect();\n    let Some(y) = opt else { return Ok(()) };\n    if let Some(z) = a { b(); } else if x > 1 && y { c() } else { d() }\n    let k = if x > 0 { 1 } else { 2 };\n"
     "    match x { 0 => {} 1 | 2 if y => foo(), 3..=5 => { bar(); } E::C { x, .. } => x, _ => unreachable!() }\n    while let Some(t) = it.next() { continue; }\n    'o: loop { break 'o; }\n    for (i, j) in v.iter().enumerate() { println!(\"{}\", i as f64); }\n    let s = S { a: \"x\", ..Default::default() };\n    let c = move |a: i32| -> i32 { a + 1 };\n    unsafe { *p = 1; }\n    let arr = [0u8; 4];\n    x += foo::<i32>(&mut y)?;\n    f(x).await?;\n    Ok(())\n}\n"
     "macro_rules! m { ($x:expr) => { $x } }\nconst N: usize = 3;\nstatic mut G: i32 = 0;\ntrait T { type O; fn f(&self) -> Self::O; fn g() {} }\n"),
    ("python", "#!/usr/bin/env python\n\"\"\"doc\"\"\"\nfrom __future__ import annotations\nimport os, sys as s\nfrom . import x\nfrom a.b import (c, d as e,)\nfrom q import *\n\n@dec(1)\n@a.b\nclass A(B, metaclass=M):\n    x: int = 1\n\n    def f(self, a, *args, b=2, **kw) -> dict[str, int]:\n        if a and not b or a is not None:\n            return {**a, 'k': [i for i in range(3) if i % 2 == 0]}\n        elif a in b: pass\n        else:\n            raise E(f'{a!r}') from None\n"
     "        try:\n            with open(a) as f, g() as h:\n                yield from f\n        except (A, B) as e:\n            print(e, file=sys.stderr)\n        except Exception:\n            raise\n        else:\n            del a[0], b\n        finally:\n            pass\n        for i, (j, k) in enumerate(x):\n            continue\n        else:\n            x = lambda a, *b: a if a else b\n        while True: break\n        a, *b = c = d[1:2, ::3]\n        assert a, 'm'; global z\n        x = yield\n        return\n\n"
     "async def g():\n    async with a as b:\n        await c\n    async for d in e:\n        print(d)\n    x = (i async for i in y)\n    if (n := len(a)) > 1: return -n ** 2 @ m\n    match a:\n        case [1, _]:\n            pass\n        case {'x': 1}:\n            pass\n\nx = '''a\nb''' 'c'\ny = a[\n    1]\nprint(*a, **b)\n"),
])
def test_p5_takes_valid_sources_as_they_are(grammar, text):
    assert not _problems(text, grammar)


def test_p5_recall_and_precision_on_planted_breaks(spark):
    """Valid sources of every language, and the same with one sign outside strings and comments deleted or doubled; Python's own parser says
    which of its texts are broken."""
    import ast
    import re

    rng = random.Random(4)
    rows, broken = [], set()
    hidden = re.compile(r"""#(?!include)[^\n]*|//[^\n]*|/\*.*?\*/|\"(?:\\.|[^"\\])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|/\[[^/\n]*\]/""", re.S)
    for path, text in sorted(GOOD.items()):
        ext = path.rsplit(".", 1)[1]
        rows.append((f"ok-{path}", f"/r/{path}", text))
        shown = hidden.sub(lambda m: " " * len(m.group(0)), text)
        for sign in "(){}" + (";" if ext in ("java", "cs", "php", "rust") else ":" if ext == "py" else ""):
            for how in ("drop",) if sign == ";" else ("drop", "double"):
                for at in rng.sample(places := [i for i, c in enumerate(shown) if c == sign], min(6, len(places))):
                    fid, made = f"{how}-{path}-{sign}-{at}", text[:at] + ("" if how == "drop" else sign * 2) + text[at + 1 :]
                    if ext == "py":
                        try:
                            ast.parse(made)
                            continue
                        except SyntaxError:
                            pass
                    rows.append((fid, f"/r/{path}", made))
                    broken.add(fid)
    df = spark.createDataFrame(rows, "file_id string, path string, source_text string").withColumn("short_path", F.col("path"))
    found = {r.file_id for r in syntax.broken_files(df).collect()}
    assert not found - broken, sorted(found - broken)[:5]
    assert len(broken) > 200 and len(found & broken) >= 0.95 * len(broken), (len(broken), sorted(broken - found))


def test_p1_names_without_blanks():
    for name in ("王小明", "김철수"):
        parsed = names.parse_author(name, "x@y.example")
        assert (parsed["kind"], parsed["family"], parsed["given"]) == ("person", name[0], name[1:])


def test_p1_channel_rates_come_from_confirmed_spellings(spark):
    forms = [("P|eleanor|pelvol", 50), ("P|elenaor|pelvol", 1), ("P|ellie|pelvol", 1), ("P|robert|zulan", 9), ("P|bob|zulan", 2), ("P|other|name", 1)]
    mails = [(f, "a@x") for f, _ in forms[:3]] + [(f, "b@x") for f, _ in forms[3:]]
    got = names.channel_likelihoods(spark.createDataFrame(forms, "form string, freq bigint"), spark.createDataFrame(mails, "form string, mailbox string"))
    # two exact, two short, one typo beside the prior of 200 spellings
    assert math.exp(got["short"]) == pytest.approx((2 + 2) / 205) and math.exp(got["typo"]) == pytest.approx((1 + 2) / 205) and got["mailbox"] == names.LIKELIHOOD["mailbox"]
    assert [names.channel_of("P|a|b", x) for x in ("P|a|b", "P|b|a", "P|aa|b", "O|x y")] == [None, None, "typo", "name"]
