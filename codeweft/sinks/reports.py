"""Reports as rows: JSON, OpenMetrics, SARIF, Markdown; CSV by Spark's own writer."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import slug
from codeweft.operators.review import METHODOLOGY
from codeweft.session import cut_lineage

#: SARIF level of a severity; all others are warnings.
LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """``(key, json)``: each row as one JSON object, NaN as 0."""
    clean = [F.when(F.isnan(c), 0.0).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*clean).select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


#: The gauges of the OpenMetrics report and what they say (fixed values).
GAUGES = {
    "cyclomatic_complexity": "Cyclomatic complexity of the code", "lines_of_code": "Lines of code", "logical_lines_of_code": "Logical lines of code", "comment_lines_of_code": "Comment lines of code", "maintainability": "Maintainability index",
    "maintainability_without_comments": "Maintainability index without comments", "number_of_functions": "Number of functions", "number_of_classes": "Number of classes", "afferent_coupling": "Afferent coupling", "efferent_coupling": "Efferent coupling",
}


def open_metrics(df: DataFrame, label: str, gauges: Sequence[str] = tuple(GAUGES)) -> DataFrame:
    """``(gauge, line)``: one line per row and gauge, and a HELP and a TYPE line for each gauge; null measures give none."""
    pairs = F.array(*[F.struct(F.lit(g).alias("g"), F.col(g).cast("double").alias("v")) for g in gauges])
    long = df.select(F.col(label).alias("label"), F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull())
    escaped = F.replace(F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    whole = (F.col("p.v") == F.floor("p.v")) & (F.abs("p.v") < 1e15)
    number = F.when(whole, F.col("p.v").cast("bigint").cast("string")).otherwise(F.round("p.v", 6).cast("string"))
    lines = long.select(F.col("p.g").alias("gauge"), F.format_string("%s{path=\"%s\"} %s", F.col("p.g"), escaped, number).alias("line"))
    head = df.sparkSession.createDataFrame([(g, x) for g in gauges for x in (f"# HELP {g} {GAUGES.get(g, g)}", f"# TYPE {g} gauge")], "gauge string, line string")
    return lines.unionByName(head)


def sarif_results(violations: DataFrame) -> DataFrame:
    """``(rule, rule_index, level, file, line, fingerprint)``; rules are numbered in the order they are first seen (by file, line, then name), lines start at 1."""
    first = violations.groupBy("rule").agg(F.min(F.struct("file", "line")).alias("first"))  # as many rows as rules
    index = first.select("rule", (F.row_number().over(Window.orderBy("first", "rule")) - 1).alias("rule_index"))
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("severity")), F.lit("warning"))
    v = violations.join(F.broadcast(index), "rule")
    line = F.greatest(F.coalesce("line", F.lit(1)), F.lit(1))
    print_ = F.sha2(F.concat_ws("\u0000", "rule", "file", F.coalesce("line", F.lit(0)).cast("string")), 256)
    return v.select("rule", "rule_index", level.alias("level"), "file", line.alias("line"), print_.alias("fingerprint"))


#: Results that one SARIF document holds at most, as its consumers take no more.
SARIF_RESULTS = 5000


def sarif_document(results: DataFrame, most: int = SARIF_RESULTS) -> DataFrame:
    """One row with the SARIF 2.1.0 document of the first ``most`` results; the table of results holds all."""
    shown = results.orderBy("rule_index", "file", "line").limit(most)
    item = F.struct(F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    run = shown.agg(F.transform(F.array_sort(F.collect_set(F.struct("rule_index", F.col("rule").alias("id")))), lambda r: F.struct(r["id"].alias("id"))).alias("rules"), F.collect_list(item).alias("results"))
    return run.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit("codeweft").alias("name"), "rules").alias("driver")).alias("tool"), "results")).alias("runs"))).alias("sarif"))


def dictionary(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(id, value)`` of every distinct string of ``columns``, and ``df`` with ids in their place; a null stays null."""
    values = df.select(F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("value")).distinct()
    table = cut_lineage(values.select(F.monotonically_increasing_id().alias("id"), "value"))
    out = df
    for c in columns:
        out = out.join(table.select(F.col("value").alias(c), F.col("id").alias(f"__{c}")), c, "left").drop(c).withColumnRenamed(f"__{c}", c)
    return table, out.select(*df.columns)


def pruned(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the columns (and fields of structs, as ``a.b``) that a report shows; the scan reads no others."""
    return files.select(*[F.col(c).alias(c.replace(".", "_")) for c in keep])


def html_pages(summary: DataFrame, title: str = "Code report") -> DataFrame:
    """``(page, html)``: one page per row of ``summary(kind, name, ...)`` with its numbers as a table; page names are slugs."""
    numbers = [c for c in summary.columns if c not in ("kind", "name")]
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(*[F.concat(F.lit(f"<tr><th>{n}</th><td>"), safe(n), F.lit("</td></tr>")) for n in numbers])
    html = F.concat(F.lit(f"<!doctype html><title>{title}: "), safe("name"), F.lit("</title><h1>"), safe("name"), F.lit("</h1><table>"), body, F.lit("</table>"))
    page = F.concat_ws("-", slug("kind"), slug(F.replace(F.col("name"), F.lit("#"), F.lit("-sharp"))))
    return summary.select(F.concat(page, F.lit(".html")).alias("page"), html.alias("html"))


def markdown_table(rows: list[dict]) -> str:
    """A small, already collected result as a Markdown table."""
    if not rows:
        return ""
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if r[h] is None else str(r[h]) for h in head) + " |" for r in rows])


#: Template of the Markdown report; ``|filter`` may follow a name.
MARKDOWN = "# {title}\n\n{files|number} files, {loc|number} lines, mean complexity {ccn|round}, mean maintainability {mi|round} ({mi|band})\n\n## Riskiest files\n\n{risky|table}\n"
_FILTERS = {
    "number": lambda x: f"{x // 1_000_000} M" if x >= 1_000_000 else f"{x // 1000} K" if x >= 1000 else str(x), "round": lambda x: "" if x is None else f"{x:.2f}",
    "band": lambda x: "" if x is None else "red" if int(x) < 65 else "yellow" if int(x) < 85 else "green", "table": markdown_table,
}


def markdown_report(values: dict, template: str = MARKDOWN) -> str:
    """The report of small, already collected values: ``{name}`` and ``{name|filter}`` of the template are filled in."""
    def fill(m: re.Match) -> str:
        value = values.get(m.group(1))
        return _FILTERS[m.group(2)](value) if m.group(2) else "" if value is None else str(value)

    return re.sub(r"\{(\w+)(?:\|(\w+))?\}", fill, template)


def review_report(findings: DataFrame, base: str, form: str = "text", most: int = 50) -> str:
    """A review of ``findings(kind, severity, subject, before, after)`` as text, markdown or json.

    Regressions come by severity, then subject and kind; text and markdown show ``most`` of them and three improvements and say
    how many more there are.  JSON holds up to ``most`` as well and the whole counts; the table of findings holds all.
    """
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    better = F.col("kind").endswith("improvement")
    counts = findings.agg(F.count_if(~better).alias("bad"), F.count_if(better).alias("good"), F.count_if(~better & (F.col("severity") == "high")).alias("high")).first()
    top = lambda cond, n: [r.asDict() for r in findings.where(cond).orderBy(rank, "subject", "kind").limit(n).collect()]
    bad, good = top(~better, most), top(better, 3)
    if form == "json":
        return json.dumps({"base": base, "methodology": METHODOLOGY, "regressions": counts["bad"], "improvements": counts["good"], "findings": bad + good}, default=str)
    head = f"{counts['bad']} regressions ({counts['high']} high), {counts['good']} improvements compared with {base}"
    line = (lambda r: f"- **{r['kind']}** (`{r['subject']}`, {r['severity']}): {r['before']} -> {r['after']}") if form == "markdown" else (lambda r: f"- [{r['severity'].upper()}] {r['kind']} ({r['subject']}): {r['before']} -> {r['after']}")
    out = [("## " if form == "markdown" else "") + head]
    for name, rows, n in (("Regressions", bad, counts["bad"]), ("Improvements", good, counts["good"])):
        if rows:
            out += ["", ("### " if form == "markdown" else "") + name + ("" if form == "markdown" else ":"), *map(line, rows)]
            if n > len(rows):
                out.append(f"... and {n - len(rows)} more")
    return "\n".join([*out, "", f"Methodology {METHODOLOGY}"]) + "\n"


class Reporter(Protocol):
    """A sink: writes a table under a path and returns where it is."""

    def __call__(self, table: DataFrame, path: str) -> str: ...


def _lines(table: DataFrame, path: str) -> str:
    table.select("line").write.mode("overwrite").text(path)
    return path


def _writer(form: str) -> Reporter:
    def write(table: DataFrame, path: str) -> str:
        w = table.write.mode("overwrite")
        (w.option("header", "true") if form == "csv" else w).format(form).save(path)
        return path

    return write


#: Sinks by the key under which a configuration names their path.
REPORTERS: dict[str, Reporter] = {"json": _writer("json"), "csv": _writer("csv"), "parquet": _writer("parquet"), "openmetrics": _lines}


def reporters(config: dict[str, str]) -> list[tuple[Reporter, str]]:
    """One sink for each configured output ``{kind: path}``; an empty path configures none, an unknown kind is an error."""
    unknown = sorted(set(config) - set(REPORTERS))
    if unknown:
        raise ValueError(f"unknown reports: {', '.join(unknown)}")
    return [(REPORTERS[k], path) for k, path in config.items() if path]
