"""Generated, minified, vendored or data-only files, so that hand-written source remains."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import hot_cold_join, lookup_join
from codeweft.session import cut_lineage, spread

#: Phrases of generation notices (fixed values): 2 where a phrase says by itself that a tool wrote the file, 1 where it does
#: so only beside another; a comment needs a sum of 2.
GENERATED_PHRASES = {
    "auto-generated": 2, "autogenerated": 2, "auto generated": 2, "<auto-generated": 2, "@generated": 2, "automatically generated": 2, "generated automatically": 2,
    "code generated by": 2, "generated by": 2, "generated with": 2, "generated from": 2, "generated code": 1, "generated file": 1, "file is generated": 2, "file was generated": 2,
    "this is a generated": 2, "created automatically": 2, "automatically created": 2, "machine written": 2, "machine generated": 2, "machine-generated": 2, "produced by": 1,
    "compiled from": 1, "written by a tool": 2, "do not edit": 1, "do not modify": 1, "don't edit": 1, "do not change": 1, "never edit": 1, "edits will be lost": 2, "changes will be lost": 2,
    "edit is overwritten": 2, "will be overwritten": 2, "are overwritten": 1, "is overwritten": 1, "regenerate": 1, "scaffolded by": 1, "to refresh": 1, "instead of editing": 1, "erzeugt": 1, "automatisch erzeugt": 2, "automatisch generiert": 2,
    "nicht bearbeiten": 1, "nicht ändern": 1, "généré automatiquement": 2, "généré par": 2, "ne pas modifier": 1, "generado por": 2, "generado automáticamente": 2, "no editar": 1, "no modificar": 1,
    "gerado automaticamente": 2, "não edite": 1, "自动生成": 2, "請勿編輯": 1, "请勿编辑": 1, "自動生成": 2, "編集しないで": 1,
}
#: What makes a phrase a mention and no notice: quotes around it, a denial before it, a clause about other files.
_QUOTED = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`|‘[^’\n]*’|“[^”\n]*”|«[^»\n]*»")
_DENIED = re.compile(r"\b(?:not|never|no|isn't|wasn't|aren't|without|nothing|hand|un|kein\w*|nicht)\b[\s-]*(?:\w+[\s-]+){0,2}$")
_CLAUSE = re.compile(r"\b(?:if|whether|that|which|when|where|unless|like|than)\b")
_WORDY = re.compile(r"[^\W\d_][\w'-]*")
_BE = frozenset("is was were are be been being wurde wird werden".split())
#: Phrases of notices of another project (fixed values).
FOREIGN = re.compile(
    r"\(c\) the ([\w.-]+) (?:contributors|authors|project|developers)|upstream copy|part of ([\w.-]+) \(v?\d+(?:\.\d+)+\)|see license\.[\w-]+ for terms|^[\W_]*([\w.-]+) v?\d+\.\d+\.\d+ (?:-|\|) (?:https?://|\(c\))"
    r"|copyright \(c\) the [\w.-]+ project|imported from upstream|vendored from|copied from https?://|/\*!\s*[\w.-]+(?: v?\d[\w.]*)? (?:bundle|v?\d)",
    re.I | re.M,
)
#: Folders that hold other projects whatever lies in them, and folders that do so only with evidence of another project.
VENDOR_DIRS = frozenset(("node_modules", "bower_components", ".venv", "venv", "site-packages", "pods", "carthage", ".cargo", ".yarn", ".bundle", "third_party", "third-party", "thirdparty", "3rdparty", "_vendor", "godeps"))
WEAK_VENDOR_DIRS = frozenset(("vendor", "deps", "external", "extern", "packages", "lib", "libs", "contrib", "Packages"))
#: Files by which package managers and projects mark a folder as a project of its own (fixed values).
MANIFEST = re.compile(r"^(?:modules\.txt|autoload\.php|installed\.(?:json|php)|composer\.json|package\.json|bower\.json|cargo\.toml|go\.mod|setup\.(?:py|cfg)|pyproject\.toml|pom\.xml|[\w.-]+\.(?:nuspec|gemspec)|(?:un)?licen[cs]e(?:[.-][\w.-]+)?|copying(?:\.\w+)?|notice(?:\.\w+)?)$", re.I)
#: A folder named like the host of a module path, such as github.com.
_HOST = re.compile(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|io|in|dev|cn|de|edu|sh|me|ai)$")
#: File names of build output, and of lock files (fixed patterns).
GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h)|_pb\.(?:d\.ts|js|ts|rb)|grpc\.(?:java|cs|php)|outerclass\.java|gpbmetadata\.php|\.g\.(?:i\.)?cs|\.designer\.cs|\.generated\.\w+|_generated\.\w+|\.gen\.\w+|_gen\.(?:go|rs|ts|py)|_string\.go|zz_generated\.\w+|\.g\.dart|_mock\.gen\.go)$",
    re.I,
)
LOCKFILE = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|cargo\.lock|go\.sum|gemfile\.lock|poetry\.lock|pipfile\.lock|packages\.lock\.json)$", re.I)
MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|mjs|cjs|ts|css)$|\.bundle\.js$|\.chunk\.js$", re.I)

_VERSION = re.compile(r"^([a-z][\w]*?)[.-]v?\d+(?:\.\d+)+$", re.I)
_MEMBER = re.compile(r"\b(?:function|def|func|fn|int|void|string|double|public|long|bool)\s+(?:\([^)]*\)\s*)?([A-Za-z_]+?)_?(\d{2,5})\s*\(|^\s+([A-Za-z_]+?)_?(\d{2,5})\([^)]*\)\s*(?::\s*\w+\s*)?\{", re.M)
_CALL_NUMBER = re.compile(r"\d\s*\(")
_DATA_LINE = re.compile(r"^\s*(?:[-+]?(?:0x)?[\da-fA-F][\d.eE_]*[LlUuFf]*\s*,?\s*)+$|^\s*(?:b?[\"'][^\"'\s]{40,}[\"']\s*[.+,\\]?\s*)+[;)]*\s*$|^\s*(?:(?:\\x[\da-fA-F]{2}){8,}|[A-Za-z\d+/=]{60,})[;,\"')]*\s*$")
_HEAD_LINE = re.compile(r"^\s*(?://|#(?!\[|include|define|if|region)|/\*|\*|\*/|--|<!--|;|%|\"\"\"|'''|<\?php\s*$|#!)")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, weight in GENERATED_PHRASES.items():
        a.add_word(phrase, (phrase, weight))
    a.make_automaton()
    return a


def header_of(text: str) -> str:
    """The comment lines before the first line of code, however many there are."""
    out, block, quoted = [], False, ""
    for line in text.split("\n"):
        s = line.strip()
        if block:
            out.append(s)
            block = "*/" not in s
        elif quoted:
            out.append(s)
            quoted = "" if quoted in s else quoted
        elif not s:
            continue
        elif _HEAD_LINE.match(s):
            out.append(s)
            block = s.startswith("/*") and "*/" not in s
            if s[:3] in ('"""', "'''") and s.count(s[:3]) == 1:
                quoted = s[:3]
        else:
            break
    return "\n".join(out)


def _speaks_of(before: str) -> bool:
    """Whether a sentence that starts with ``before`` speaks about notices or other files where the phrase then stands.

    "Detects files generated by ..." and "checks that they are not generated from ..." do; "classes generated from ..." and
    "this file was generated by ..." are about the file itself.
    """
    if _DENIED.search(before) or _CLAUSE.search(before):
        return True
    words = _WORDY.findall(before)
    if not words or words[-1] in _BE:
        return False
    verb = words[0].endswith("s") and len(words[0]) > 3 and words[0] not in ("this", "does")
    return verb and len(words) >= 2


def header_generated(header: str) -> bool:
    """A notice that says that a tool wrote the file: phrases of one comment weigh 2 or more.

    Phrases in quotes, after a denial, or in a sentence about other files are mentions and count for nothing.
    """
    low = header.lower()
    for part in re.split(r"\n\s*\n|(?<=\*/)\n", low):
        part = _QUOTED.sub(lambda m: " " * len(m.group(0)), part)
        weights: dict[str, int] = {}
        for end, (phrase, weight) in _automaton().iter(part):
            at = end - len(phrase) + 1
            start = max(part.rfind(". ", 0, at), part.rfind("! ", 0, at), part.rfind("; ", 0, at), part.rfind("\n", 0, at)) + 1
            if not _speaks_of(part[start:at]):
                weights[phrase] = weight
        if sum(w for p, w in weights.items() if not any(p != q and p in q for q in weights)) >= 2:
            return True
    return False


def path_vendored(path: str) -> str | None:
    """Name of the other project a path lies in, or None.

    ``vendor``, ``lib`` and the like are words that a project may use for its own folders, so they count only with
    evidence in the path: a module path with a host, a version, a file named like its folder, the layout
    owner/package below a ``vendor`` at the root, or a package manager's file.  ``judge_files`` adds evidence from other files.
    """
    parts = [p for p in path.split("/") if p]
    stem = parts[-1].split(".")[0].lower() if parts else ""
    for i, p in enumerate(parts[:-1]):
        low = p.lower()
        below = parts[i + 1 : -1]
        if low in VENDOR_DIRS and (low not in ("third_party", "third-party", "thirdparty", "3rdparty") or below):
            rest = [x for x in below if x.lower() not in ("lib", "site-packages", "src", "dist")]
            return rest[0].lower() if rest else stem
        if p in WEAK_VENDOR_DIRS:
            if p == "vendor" and (not below or below == ["composer"]) and MANIFEST.match(parts[-1]):
                return stem
            if not below:
                continue
            if _HOST.match(below[0].lower()):
                return "/".join(below[:3]).lower()
            if (m := _VERSION.match(below[0])) is not None:
                return m.group(1).lower()
            if low not in ("lib", "libs", "packages") and (stem == below[0].lower() or stem.startswith((below[0].lower() + "_", below[0].lower() + "-"))):
                return below[0].lower()
            if p == "vendor" and i == 0 and len(below) >= 2 and below[1].lower() not in ("src", "lib", "test", "tests"):
                return "/".join(below[:2]).lower()
    return None


def vendor_root(path: str) -> tuple[str | None, str | None]:
    """``(root, tail)``: the project's folder below a folder that may hold other projects, and the path from there on.

    Where a path lies below no such folder, or directly in it, both are None.
    """
    parts = [p for p in path.split("/") if p]
    for i, p in enumerate(parts[:-2]):
        if p in WEAK_VENDOR_DIRS and p not in ("lib", "libs"):
            return "/".join(parts[: i + 2]), "/".join(parts[i + 1 :])
    return None, None


def numbered_series(text: str) -> bool:
    """At least ten members of one name with consecutive numbers: a tool wrote them."""
    if len(_CALL_NUMBER.findall(text)) < 10:
        return False
    series: dict[str, set[int]] = {}
    for m in _MEMBER.finditer(text):
        series.setdefault(m.group(1) or m.group(3), set()).add(int(m.group(2) or m.group(4)))
    numbers = [n for group in series.values() for n in group]
    if len(numbers) < 10:
        return False
    pooled = sorted(set(numbers))
    steps = sum(b - a == 1 for a, b in zip(pooled, pooled[1:]))
    return steps >= 0.8 * (len(pooled) - 1) and len(pooled) >= 10


def content_kind(text: str) -> str | None:
    """``minified`` or ``data`` by the shape of all lines, or None."""
    lines = [x for x in text.split("\n") if x.strip()]
    total = sum(map(len, lines))
    if not total:
        return None
    # blobs open hardly any blocks and call nothing
    if total >= 400 and text.count("(") + text.count("{") < 0.2 * len(lines) + 3 and sum(len(x) for x in lines if _DATA_LINE.match(x)) >= 0.8 * total:
        return "data"
    long = sum(len(x) for x in lines if len(x) > 400)
    if long >= 0.5 * total:
        longest = max(lines, key=len)
        blanks = sum(c.isspace() for c in longest) / len(longest)
        if blanks < 0.09:
            code = sum(longest.count(x) for x in ("function", "=>", ";", "){", "return")) / len(longest)
            return "minified" if code > 0.004 else "data"
    return None


def _judge(path: str | None, text: str | None) -> tuple[str | None, str | None, str]:
    """``(reason, other project, body)`` of one file by itself."""
    path = path or ""
    project = path_vendored(path)
    if LOCKFILE.search(path):
        return "lockfile", None, ""
    if not text or not text.strip():
        return ("vendored path" if project else "minified name" if MINIFIED_NAME.search(path) else None), project, ""
    header = header_of(text)
    body = "".join((_strip_header(text, header) if header else text).split())
    if project:
        return "vendored path", project, body
    if FOREIGN.search(header):
        return "third-party notice", None, body
    if header_generated(header):
        return "generation notice", None, body
    if MINIFIED_NAME.search(path):
        return "minified name", None, body
    kind = content_kind(text)
    if kind:
        return kind, None, body
    if GENERATED_NAME.search(path):
        return "generated name", None, body
    if numbered_series(text):
        return "numbered members", None, body
    return None, None, body


def _strip_header(text: str, header: str) -> str:
    """The text without its leading comments."""
    lines = text.split("\n")
    n = len(header.split("\n"))
    seen = i = 0
    while i < len(lines) and seen < n:
        seen += bool(lines[i].strip())
        i += 1
    return "\n".join(lines[i:])


def judge_files(files: DataFrame) -> DataFrame:
    """``(file_id, repo, programming_language, reason)``; reason is null for hand-written files.

    1. Each file by itself: path rules (vendored folders, lock files, minified and build-output
       suffixes), generation and third-party notices in the leading comments by one Aho-Corasick pass,
       and, beyond the method named, the shape of the lines (minified code, blobs of numbers or encoded strings) and
       numbered members.
    2. Evidence in other files: a folder below ``vendor``, ``deps`` and the like that holds a manifest or licence of its own,
       or a file whose path from there on and body stand in another repo too, is another project's.
    3. Copies of other projects among a repo's own folders: files with the body (header and blanks
       aside) of a file that 1 or 2 take for another project's, or with its file name there and its body's
       declared name.  Hot bodies and names are looked up by broadcast (``hot_cold_join``), others by a join.

    is_test does not matter: a vendored test is still vendored.  Null paths and null or empty texts are judged
    by what is there; rows with a null file_id are kept.
    """
    own = files.select("file_id", "repo", "programming_language", "path", "short_path", "source_text")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for path, short, text in zip(b["path"], b["short_path"], b["source_text"]):
                where = short if isinstance(short, str) and short else path
                where = where if isinstance(where, str) else None
                reason, project, body = _judge(where, text if isinstance(text, str) else None)
                name = (where or "").rsplit("/", 1)[-1]
                stem = re.sub(r"\d+$", "", name.split(".")[0]).lower()
                digest = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if len(body) >= 80 else None
                root, tail = vendor_root(where or "") if reason is None or project is None else (None, None)
                # a manifest marks the folder it lies in, not folders further down
                marks = root is not None and MANIFEST.match(name) is not None and tail.count("/") == 1
                rows.append((reason, project, stem or None, digest, root, tail, marks))
            out = pd.DataFrame(rows, columns=["reason", "project", "stem", "digest", "root", "tail", "marks"], dtype=object)
            yield pd.concat([b[["file_id", "repo", "programming_language"]].reset_index(drop=True), out], axis=1)

    schema = "file_id string, repo string, programming_language string, reason string, project string, stem string, digest string, root string, tail string, marks boolean"
    judged = cut_lineage(spread(own).mapInPandas(judge, schema))
    rows = judged.count()
    # evidence in other files, over the few files that lie in such folders
    doubtful = judged.where(F.col("root").isNotNull() & F.col("project").isNull()).select("file_id", "repo", "root", "tail", "digest", "marks")
    marked = doubtful.where("marks").select("repo", "root").distinct().withColumn("has_manifest", F.lit(True))
    repeated = doubtful.where("digest is not null").groupBy("tail", "digest").agg(F.min("repo").alias("x"), F.max("repo").alias("y")).where("x <> y").select("tail", "digest", F.lit(True).alias("elsewhere"))
    foreign_root = doubtful.join(repeated, ["tail", "digest"], "left").groupBy("repo", "root").agg(F.max(F.coalesce("elsewhere", F.lit(False))).alias("found"), F.count(F.lit(1)).alias("n"))
    foreign_root = cut_lineage(foreign_root.join(marked, ["repo", "root"], "left").where(F.col("found") | F.col("has_manifest")).select("repo", "root", "n", F.lit("third-party folder").alias("folder")))
    # a null root must not gather in one task
    keyed = lambda c: F.coalesce(c, F.concat(F.lit("~"), F.coalesce("file_id", F.lit(""))))
    judged = lookup_join(judged.withColumn("root", keyed("root")), foreign_root, ["repo", "root"], "n", rows, how="left").drop("n")
    judged = cut_lineage(judged.withColumn("reason", F.coalesce("reason", "folder")).drop("folder", "root", "tail", "marks"))
    foreign = F.col("reason").isin("vendored path", "third-party notice", "third-party folder")
    bodies = judged.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(foreign.cast("int")).alias("copied")).where("copied = 1").select("digest", "n", F.lit(True).alias("body_copied"))
    # names such as mosslex_util that only vendored folders of that project gave rise to
    names = judged.where(F.col("stem").isNotNull()).groupBy("stem").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("project").isNotNull() & F.col("stem").contains(F.concat(F.col("project"), F.lit("_")))).cast("int")).alias("known")
    ).where("known = 1").select("stem", "n", F.lit(True).alias("name_known"))
    both = judged.withColumn("digest", keyed("digest")).withColumn("stem", keyed("stem"))
    both = hot_cold_join(both, bodies, ["digest"], "n", rows, how="left").drop("n")
    both = hot_cold_join(both, names, ["stem"], "n", rows, how="left")
    reason = F.coalesce(F.col("reason"), F.when(F.col("body_copied"), F.lit("copy of a third-party file")), F.when(F.col("name_known"), F.lit("third-party name")))
    return both.select("file_id", "repo", "programming_language", reason.alias("reason"))
