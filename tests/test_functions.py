"""Golden values of the metric and text functions."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.functions import text as X


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_maintainability_golden(spark):
    m = M.maintainability(F.lit(10), F.lit(8), F.lit(2), F.lit(3), F.lit(10.0))
    r = one(spark, **m)
    assert (int(r.mi), int(r.mi_woc), int(r.comment_weight)) == (104, 72, 31)


def test_maintainability_without_volume_or_lines(spark):
    assert one(spark, **M.maintainability(F.lit(10), F.lit(8), F.lit(2), F.lit(3), F.lit(0.0))).mi is None
    assert one(spark, **M.maintainability(F.lit(0), F.lit(0), F.lit(0), F.lit(3), F.lit(5.0))).mi == 0


def test_halstead_golden(spark):
    r = one(spark, **M.halstead(F.lit(3), F.lit(1), F.lit(3), F.lit(1)))
    assert r.h_est_length == pytest.approx(4.754887502163469) and r.h_volume == 8 and r.h_difficulty == 1.5
    r = one(spark, **M.halstead(F.lit(3), F.lit(3), F.lit(4), F.lit(4)))
    assert (r.h_length, r.h_vocabulary) == (8, 6)
    r = one(spark, **M.halstead(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    assert (r.h_length, r.h_volume, r.h_bugs) == (0, 0, None)


@pytest.mark.parametrize("name, depth, want", [
    ("com.example.package", 2, "com.example"), ("abcd/def/ghi/lkm", 2, "abcd/def"), ("abcd/def.ghi.lkm", 1, "abcd"), ("abcd", 2, "abcd"), ("github.com/test/test/test/test", 1, "github.com/test"),
    ("github.com/test.test.test.test", 3, "github.com/test/test/test"), ("github.com/test.test", 3, "github.com/test.test"), ("one.two.three.four", 3, "one.two.three"), ("/a/b/c", 2, "a"),
])
def test_reduce_namespace(spark, name, depth, want):
    assert one(spark, x=M.reduce_namespace(F.lit(name), depth)).x == want


def test_risk_bounds(spark):
    r = one(spark, top=M.risk(F.lit(10), F.lit(10), F.lit(5), F.lit(5)), none=M.risk(F.lit(10), F.lit(0), F.lit(5), F.lit(0)), flat=M.risk(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    assert (r.top, r.none, r.flat) == (1, 0, 1)


@pytest.mark.parametrize("fan, want", [(0, "Isolated"), (1, "Isolated"), (3, "Semi-isolated"), (10, "Coupled")])
def test_isolation(spark, fan, want):
    assert one(spark, x=M.isolation_label(M.isolation_score(F.lit(fan), F.lit(1)))).x == want


def test_text_functions(spark):
    r = one(spark, t=X.tokens(F.lit("A Foo_bar x yz")), g=X.ngrams(X.tokens(F.lit("aa bb cc")), 1, 2), w=X.identifier_words(F.lit("HTTPServer2Go_fast")), k=X.lint_message_key(F.lit("/r/x has 12"), "/r/"))
    assert r.t == ["foo_bar", "yz"] and r.g == ["aa", "bb", "cc", "aa bb", "bb cc"]
    assert r.w == ["http", "server", "2", "go", "fast"] and r.k == "x has #"


@pytest.mark.parametrize("word, want", [("", 0), ("a", 0x3C2569B2), ("hello", 0x248BFA47), ("hello, world", 0x149BBB7F)])
def test_murmur(word, want):
    assert X.murmur3_32(word.encode()) == want


def test_short_forms(spark):
    r = one(spark, a=M.short_number(F.lit(1234)), b=M.short_number(F.lit(12)), c=M.short_name(F.lit("A\\B::c.d")), d=M.mi_band(F.lit(64.9)))
    assert (r.a, r.b, r.c, r.d) == ("1 K", "12", "d", "red")
