"""Code metrics as column expressions; every argument is a Column or column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _finite(x: Column) -> Column:
    """``x`` with NaN and infinities as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def cyclomatic(loops="n_loop", ifs="n_if", elseifs="n_elseif", cases="n_case", switches="n_switch", else_ifs=None, baseline: int = 1) -> Column:
    """Decisions plus ``baseline``; an else that directly holds an if counts once more (``else_ifs``)."""
    parts = [F.coalesce(_c(x), F.lit(0)) for x in (loops, ifs, elseifs, cases, switches)] + ([F.coalesce(_c(else_ifs), F.lit(0))] if else_ifs is not None else [])
    return sum(parts[1:], parts[0]) + F.lit(baseline)


def halstead(distinct_operators, distinct_operands, operators, operands) -> dict[str, Column]:
    """The Halstead measures by name; where a logarithm or quotient is undefined the measure is 0."""
    n1, n2, big1, big2 = (_c(x).cast("double") for x in (distinct_operators, distinct_operands, operators, operands))
    log2 = lambda x: F.when(x > 0, F.log2(F.when(x > 0, x))).otherwise(0.0)
    vocabulary, length = n1 + n2, big1 + big2
    volume = length * log2(vocabulary)
    difficulty = F.when(n2 > 0, n1 / 2 * (big2 / F.when(n2 > 0, n2))).otherwise(0.0)
    # an empty side leaves the estimate undefined, as 0 * log2(0) is
    estimated = F.when((n1 > 0) & (n2 > 0), n1 * log2(n1) + n2 * log2(n2)).otherwise(0.0)
    effort = difficulty * volume
    return {
        "h_vocabulary": vocabulary, "h_length": length, "h_est_length": estimated, "h_volume": volume, "h_difficulty": difficulty,
        "h_effort": effort, "h_time": effort / 18, "h_bugs": F.when(volume > 0, volume / 3000),
    }


def maintainability(loc, lloc, cloc, ccn, volume) -> dict[str, Column]:
    """``mi``, ``mi_woc`` and ``comment_weight``: null without volume, 0 where there are no lines at all."""
    loc, lloc, cloc, ccn, volume = (_c(x).cast("double") for x in (loc, lloc, cloc, ccn, volume))
    none = (loc + lloc + cloc) == 0
    ok = (volume > 0) & (lloc > 0)
    woc = F.when(ok, F.greatest(F.lit(0.0), (171 - 5.2 * F.ln(F.when(ok, volume)) - 0.23 * ccn - 16.2 * F.ln(F.when(ok, lloc))) * 100 / 171)).otherwise(0.0)
    weight = F.when(loc > 0, 50 * F.sin(F.sqrt(2.4 * cloc / F.when(loc > 0, loc)))).otherwise(0.0)
    has = volume > 0
    return {
        "mi": F.when(has, F.when(none, 0.0).otherwise(woc + weight)),
        "mi_woc": F.when(has, F.when(none, 0.0).otherwise(woc)),
        "comment_weight": F.when(has, F.when(none, 0.0).otherwise(weight)),
    }


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def risk(max_commits, commits, max_value, value) -> Column:
    """1 minus the distance from the worst corner, in [0, 1]; an axis without a positive maximum adds no distance."""
    axis = lambda top, x: F.when(top > 0, clamp01((top - x) / F.when(top > 0, top))).otherwise(0.0)
    h = axis(_c(max_commits).cast("double"), _c(commits).cast("double"))
    v = axis(_c(max_value).cast("double"), _c(value).cast("double"))
    return F.coalesce(clamp01(_finite(1 - F.sqrt(h * h + v * v))), F.lit(0.0))


def class_instability(efferent, afferent) -> Column:
    """Ce / (Ce + Ca), where both are positive."""
    ce, ca = _c(efferent).cast("double"), _c(afferent).cast("double")
    return F.when((ce > 0) & (ca > 0), ce / F.when(ce + ca > 0, ce + ca)).otherwise(0.0)


def file_instability(efferent, afferent) -> Column:
    """Ca / (Ca + Ce) of a file, the reverse of a class's (kept apart by its name)."""
    ce, ca = _c(efferent).cast("double"), _c(afferent).cast("double")
    return F.when(ce + ca > 0, ca / F.when(ce + ca > 0, ce + ca)).otherwise(0.0)


def isolation_score(fan_out, depth) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 10 * _c(fan_out) - 5 * _c(depth)))


def isolation_label(score) -> Column:
    s = _c(score)
    return F.when(s >= 80, "Isolated").when(s >= 50, "Semi-isolated").otherwise("Coupled")


def orphan_weight(ccn, efferent, afferent) -> Column:
    return F.greatest(F.lit(1), _c(ccn) * (1 + _c(efferent) + _c(afferent)))


def ratio(numerator, denominator, low: float = 0.0, high: float = 100.0) -> Column:
    """Quotient with a denominator of 0 taken as 1, clamped."""
    d = _c(denominator).cast("double")
    return F.least(F.lit(high), F.greatest(F.lit(low), _c(numerator).cast("double") / F.when(d == 0, 1.0).otherwise(d)))


def mi_band(mi) -> Column:
    m = F.floor(_c(mi))
    return F.when(m < 65, "red").when(m < 85, "yellow").otherwise("green")


def short_number(x) -> Column:
    """1234 -> '1 K', 1200000 -> '1 M'."""
    v = _c(x)
    return F.when(v >= 1_000_000, F.concat(F.floor(v / 1_000_000).cast("string"), F.lit(" M"))).when(
        v >= 1000, F.concat(F.floor(v / 1000).cast("string"), F.lit(" K"))
    ).otherwise(v.cast("string"))


def short_name(qualified) -> Column:
    """Last part of a qualified name, by ``\\``, ``::`` or ``.``."""
    return F.element_at(F.split(F.regexp_replace(_c(qualified), r"\\|::", "."), r"\."), -1)


def reduce_namespace(namespace, depth: int) -> Column:
    """The first ``depth`` parts, joined by the first separator; github.com is one part; a name no deeper is kept."""
    n = _c(namespace)
    hosted = n.startswith("github.com")
    held = F.when(hosted, F.replace(n, F.lit("github.com"), F.lit("githubcom"))).otherwise(n)
    d = F.when(hosted, F.lit(depth + 1)).otherwise(F.lit(depth))
    parts = F.split(held, "[^A-Za-z0-9]+")
    first_separator = F.regexp_extract(held, "[^A-Za-z0-9]+", 0)
    marked = F.array_join(F.slice(parts, F.lit(1), d), "\u0001")
    joined = F.regexp_replace(F.replace(marked, F.lit("\u0001"), first_separator), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    cut = F.when(hosted, F.replace(joined, F.lit("githubcom"), F.lit("github.com"))).otherwise(joined)
    return F.when(F.size(parts) <= d, n).otherwise(cut)


def is_test_path(path, language) -> Column:
    """Test files by the naming rules of each language."""
    p, lang = _c(path), _c(language)
    name = F.element_at(F.split(p, "/"), -1)
    return (
        F.when(lang == "Golang", name.endswith("_test.go"))
        .when(lang == "Python", name.rlike(r"^test_.*\.py$|_test\.py$"))
        .when(lang.isin("TypeScript", "JavaScript"), name.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$") | p.contains("__tests__/"))
        .when(lang.isin("PHP", "Java", "C#"), name.rlike(r"Tests?\.(php|java|cs)$"))
        .when(lang == "Rust", name.rlike(r"_test\.rs$") | p.contains("/tests/"))
        .otherwise(F.lit(False))
    )
