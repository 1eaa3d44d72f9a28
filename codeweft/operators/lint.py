"""Lint rules as predicates: a registry of rules over files, classes, functions and project totals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A threshold rule: rows of ``scope`` for which ``predicate`` holds are violations."""

    key: str
    ruleset: str
    severity: str
    scope: str
    predicate: Column
    value: Column
    first_only: bool = False


def threshold_rules(limits: dict[str, float]) -> list[Rule]:
    """The enabled rules, those with a limit, over columns of the contract tables.

    Files: ccn, loc, lloc, afferent, efferent, instability; classes: mi, lcom4, loc, n_methods, n_public;
    functions: loc, lloc, n_parameters, depth; project rows: tests, orphans.  A null measure violates nothing.
    """
    c = F.col
    over = lambda x: (lambda t: c(x) > t)
    catalogue = {
        "afferent_coupling": ("architecture", "unknown", "file", over("afferent"), "afferent", False),
        "efferent_coupling": ("architecture", "unknown", "file", over("efferent"), "efferent", False),
        "maintainability": ("architecture", "high", "class", lambda t: c("mi").cast("int") < t, "mi", True),
        "no_circular_dependencies": ("architecture", "low", "file", lambda t: (c("instability") > t) & (c("afferent") > 0) & (c("efferent") > 0), "instability", False),
        "max_responsibilities": ("architecture", "medium", "class", over("lcom4"), "lcom4", True),
        "no_god_class": ("architecture", "low", "class", lambda t: (c("loc") > t) & (c("n_methods") > 20) & (c("lcom4") > 10), "loc", False),
        "max_loc": ("volume", "medium", "file", over("loc"), "loc", False), "max_lloc": ("volume", "medium", "file", over("lloc"), "lloc", False),
        "max_loc_by_method": ("volume", "medium", "function", over("loc"), "loc", False), "max_lloc_by_method": ("volume", "medium", "function", over("lloc"), "lloc", False),
        "max_methods_per_class": ("volume", "medium", "class", over("n_methods"), "n_methods", False), "max_public_methods": ("volume", "medium", "class", over("n_public"), "n_public", False),
        "max_switch_cases": ("volume", "medium", "file", over("ccn"), "ccn", False), "max_nested_blocks": ("volume", "medium", "file", over("ccn"), "ccn", False),
        "max_parameters_per_method": ("volume", "medium", "function", over("n_parameters"), "n_parameters", True),
        "cyclomatic_complexity": ("complexity", "medium", "file", over("ccn"), "ccn", False), "max_nesting_depth": ("complexity", "medium", "function", over("depth"), "depth", False),
        "max_file_size": ("golang", "medium", "file", over("loc"), "loc", False),
        "min_traceability": ("testing", "high", "project", lambda t: c("traceability") < t, "traceability", False), "min_isolation_score": ("testing", "medium", "project", lambda t: c("isolation") < t, "isolation", False),
        "max_god_test_fan_out": ("testing", "medium", "test", over("fan_out"), "fan_out", False), "max_orphan_weight": ("testing", "medium", "orphan", over("weight"), "weight", False),
    }
    return [Rule(k, rs, sev, scope, pred(limits[k]), c(value).cast("double"), first) for k, (rs, sev, scope, pred, value, first) in catalogue.items() if k in limits]


def evaluate(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """``(rule, ruleset, severity, file_id, subject, value)`` of all rules, each table read once.

    Each table has ``file_id`` and ``subject``; its rules become one array per row that is exploded, so a
    table is scanned once whatever the number of rules.  Rules that report the first hit of a file only keep the
    smallest subject.
    """
    parts = []
    for scope, df in tables.items():
        own = [r for r in rules if r.scope == scope]
        if not own:
            continue
        hits = F.array(*[F.when(r.predicate, F.struct(F.lit(r.key).alias("rule"), F.lit(r.ruleset).alias("ruleset"), F.lit(r.severity).alias("severity"), F.lit(r.first_only).alias("first_only"), r.value.alias("value"))) for r in own])
        parts.append(df.select("file_id", "subject", F.explode(F.array_compact(hits)).alias("h")).select("file_id", "subject", "h.*"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    cols = ["rule", "ruleset", "severity", "file_id", "subject", "value"]
    # only the rules that report one hit a file are grouped; all others pass on without a shuffle
    once = found.where("first_only").groupBy("rule", "ruleset", "severity", "file_id").agg(F.min(F.struct("subject", "value")).alias("s")).select("rule", "ruleset", "severity", "file_id", "s.*")
    return found.where("not first_only").select(*cols).unionByName(once.select(*cols))


def outcomes(tables: dict[str, DataFrame], rules: list[Rule], excluded: dict[str, str] | None = None) -> DataFrame:
    """``(rule, file_id, n_errors, succeeded)`` of every file and rule: a file without an error of a rule succeeded in it.

    ``excluded`` maps rules to patterns of file ids that the rule leaves out.
    """
    errors = evaluate(tables, rules).groupBy("rule", "file_id").agg(F.count(F.lit(1)).alias("n_errors"))
    own = None
    for scope, df in tables.items():
        keys = [r.key for r in rules if r.scope == scope]
        if keys:
            part = df.select("file_id").distinct().select("file_id", F.explode(F.array(*[F.lit(k) for k in keys])).alias("rule"))
            own = part if own is None else own.unionByName(part)
    checked = own.distinct()
    for rule, pattern in (excluded or {}).items():
        checked = checked.where(~((F.col("rule") == rule) & F.col("file_id").rlike(pattern)))
    j = checked.join(errors, ["rule", "file_id"], "left")
    return j.select("rule", "file_id", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.col("n_errors").isNull().alias("succeeded"))


def severity_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def parse_severity(message: str) -> tuple[str, str]:
    """``[High] text`` -> ('high', 'text'); unknown without a tag."""
    m = re.match(r"^\s*\[(high|medium|low|unknown)\]\s*(.*)$", message, re.I | re.S)
    return (m.group(1).lower(), m.group(2)) if m else ("unknown", message)


def valid_dependency(source: Column, target: Column) -> Column:
    """Whether a role ``kind:category:layer`` may depend on another, by the four rules between roles.

    Controllers of the interface use no infrastructure, the domain no application, data access no interface, and rules of
    the domain only its entities and value objects.  A role without a category is free.
    """
    part = lambda c, i: F.coalesce(F.try_element_at(F.split(c, ":"), F.lit(i)), F.lit(""))
    c1, l1, c2, l2 = part(source, 2), part(source, 3), part(target, 2), part(target, 3)
    bad = (
        ((l1 == "controller") & (c1 == "interface") & target.startswith("infrastructure:")) | ((c1 == "domain") & (c2 == "app"))
        | ((c1 == "data_access") & (l2 == "interface")) | ((l1 == "rule") & (c1 == "domain") & ~((c2 == "domain") & l2.isin("entity", "value_object")))
    )
    return (c1 == "") | (c2 == "") | ~bad


def forbidden_roles(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges ``(src, dst, ...)`` that ``valid_dependency`` forbids, with both roles; ``roles(node, role)``."""
    a, b = roles.select(F.col("node").alias("src"), F.col("role").alias("from_role")), roles.select(F.col("node").alias("dst"), F.col("role").alias("to_role"))
    return edges.join(a, "src").join(b, "dst").where(~valid_dependency(F.col("from_role"), F.col("to_role")))


def risk_items(files: DataFrame) -> DataFrame:
    """Risk detectors over files: ``(file_id, risk, severity)``; severity in [0, 1]."""
    c = F.col
    go = F.when((c("language") == "Golang") & (c("n_classes") > 3), F.struct(F.lit("too many classes").alias("risk"), F.least(F.lit(1.0), 0.6 + 0.05 * (c("n_classes") - 3)).alias("severity")))
    bugs = F.when(c("bugs") >= 0.5, F.struct(F.lit("too bugged").alias("risk"), F.least(F.lit(1.0), c("bugs") / 2 + 0.3).alias("severity")))
    wide = F.when(c("n_methods") >= 30, 0.8).when(c("n_methods") >= 20, 0.5).otherwise(0.0)
    resp = F.when((c("n_methods") >= 20) | (c("lcom4") > 1), F.struct(F.lit("too many responsibilities").alias("risk"), F.greatest(wide, F.when(c("lcom4") > 1, 0.7).otherwise(0.0)).alias("severity")))
    coup = F.when(c("efferent") >= 20, F.struct(F.lit("too many efferent couplings").alias("risk"), F.when(c("efferent") >= 40, 0.85).otherwise(0.6).alias("severity")))
    return files.select("file_id", F.explode(F.array_compact(F.array(go, bugs, resp, coup))).alias("r")).select("file_id", "r.risk", F.round("r.severity", 6).alias("severity"))


def slice_prealloc(files: DataFrame, loop: str, append: str) -> DataFrame:
    """``(file_id, n)`` of files with ``n`` > 0 blocks that match ``loop`` and hold a match of ``append``."""
    blocks = F.filter(F.regexp_extract_all("source_text", F.lit(loop), F.lit(0)), lambda b: F.regexp_like(b, F.lit(append)))
    return files.select("file_id", F.size(blocks).alias("n")).where("n > 0")
