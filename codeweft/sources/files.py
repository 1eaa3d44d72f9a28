"""Reading source trees: recursive scan, languages, exclusions, module roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension -> language (fixed values).
LANGUAGES = {"php": "PHP", "go": "Golang", "py": "Python", "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "TypeScript", "java": "Java", "cs": "C#"}

#: Folders that a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = ("/vendor/", "/node_modules/", "/.git/", "/var/", "/cache/")


def scan(spark: SparkSession, root: str, glob: str | None = None, excludes: Sequence[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """``(path, short_path, language, source_text)`` of all files under ``root``; one listing for all languages.

    Files that can't be read, or that vanish in between, are left out.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(root).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("source_text"))
    short = F.regexp_replace(F.expr(f"substring(path, length('{root.rstrip('/')}') + 2)"), "^/", "")
    files = raw.select("path", short.alias("short_path"), language_of(F.col("path")).alias("language"), "source_text")
    return not_excluded(files, excludes)


def language_of(path: Column, extra: dict[str, str] | None = None) -> Column:
    """Language of a path by its extension, or null; ``extra`` maps further extensions."""
    table = {**LANGUAGES, **(extra or {})}
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(mapping, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def not_excluded(files: DataFrame, excludes: Sequence[str], path: str = "short_path") -> DataFrame:
    """Files whose path, relative to the project and with a leading slash, matches none of the patterns."""
    if not excludes:
        return files
    return files.where(~F.concat(F.lit("/"), F.regexp_replace(path, "^/", "")).rlike("|".join(f"(?:{e})" for e in excludes)))


def module_of(files: DataFrame, modules: DataFrame, path: str = "short_path") -> DataFrame:
    """``files`` with the deepest module root above each file, by equality on every ancestor folder (no theta join)."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    exploded = files.select("file_id", "repo", F.explode(folders).alias("root"))
    found = exploded.join(modules, ["repo", "root"]).groupBy("file_id").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("m"))
    return files.join(found.select("file_id", F.col("m.root").alias("root"), F.col("m.module").alias("module")), "file_id", "left")


#: Scans by (session, root, glob), so that a second search of one extension lists nothing again.
_FOUND: dict[tuple[str, str, str], DataFrame] = {}


def find(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """``scan`` of one extension, remembered until ``forget``."""
    key = (spark.sparkContext.applicationId, root, f"*.{extension.lstrip('.')}")
    if key not in _FOUND:
        _FOUND[key] = scan(spark, root, key[2])
    return _FOUND[key]


def forget() -> None:
    """Drop the remembered scans, as after a change of files."""
    _FOUND.clear()


def merged(*lists: DataFrame) -> DataFrame:
    """File lists one below the other, by column name; what a list lacks is null; repeated files stay."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header and quoted fields that may hold line ends; columns by ``schema``, else all strings."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)
