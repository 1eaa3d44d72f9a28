"""Source text to rows: lines of code, classes, functions, decisions, operators and dependencies."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut_lineage, spread

#: Comment markers of each language: line comment by slashes, by hash, block comments.
MARKERS = {"Python": (False, True, False), "PHP": (True, True, True)}
_DECISIONS = ("n_if", "n_elseif", "n_else", "n_loop", "n_case", "n_switch")
#: Keywords by what they begin (fixed values): decisions, classes, functions, and words that are no operands.
_LOOPS = frozenset("for foreach while loop".split())
_SWITCHES = frozenset("switch match select".split())
_CLASSES = frozenset("class interface struct trait enum impl record".split())
_CONTROL = frozenset("if else elseif for foreach while loop do switch match select try catch finally lock using with unsafe synchronized fixed".split())
_MODIFIERS = frozenset("public private protected internal static final abstract async export default override virtual sealed partial readonly extern unsafe pub const native synchronized".split())
_KEYWORDS = _CONTROL | _CLASSES | _MODIFIERS | frozenset(
    "elif case break continue return function func fn let var mut int string bool boolean void double float long i64 i32 u64 f64 str number any package import use namespace mod type new delete throw throws yield await extends implements "
    "where in of is as ref out move dyn range chan map defer go fallthrough goto this self super base null nil true false undefined None instanceof typeof echo print global elseif endif".split()
)
_SELF = re.compile(r"^(?:\$this|this|self|super|base|parent)(?:\.|->|::)")
_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|`(?:\\[\s\S]|[^`\\])*`?|'(?:\\.[^'\n]*|[^'\\\n]*)'|'(?=\w)|[$@]?[A-Za-z_]\w*(?:\s*(?:\.|->|::|\\)\s*\$?[A-Za-z_]\w*)*|\d[\w.]*"
    r"|\.\.\.?=?|[-=]>|<=>|[-+*/%&|^!=<>?]=+|\+\+|--|&&|\|\||<<|>>|:=|<-|[-+*/%&|^!=<>?:~]|[(){}\[\];,#@.]|\n"
)
#: Languages in which a line end may end a statement.
_LINE_ENDS = frozenset(("Golang", "TypeScript"))


class LangAdapter(Protocol):
    """What a language must provide: the units of a source text, as dicts by the names of ``UNIT_SCHEMA``."""

    def __call__(self, text: str) -> list[dict]: ...


def _unit(kind: str, name: str | None, **more) -> dict:
    return {"kind": kind, "name": name, **more}


def _counted(kind: str, name: str, start: int, **more) -> dict:
    """A class, function or file unit whose decisions and tokens are still to be counted."""
    return _unit(kind, name, start_line=start, stop_line=start, operators=[], operands=[], calls=[], attributes=[], parameters=[], parents=[], depth=0, **dict.fromkeys(_DECISIONS, 0), **more)


def line_counts(lines: list[str], slashes: bool = True, hashes: bool = True, blocks: bool = True) -> tuple[int, int, int, int]:
    """``(loc, lloc, cloc, ncloc)`` of a block of lines.

    A line with a comment marker outside quotes is a comment line, as are all lines of a block comment.  Without a
    syntax tree the logical lines are what comments, blanks and the two lines of the frame leave, at least 0.
    """
    comments = blanks = 0
    inside = False
    for raw in lines:
        line = raw.strip()
        if not line:
            blanks += 1
            continue
        bare = blank_quotes(line)
        if inside:
            comments += 1
            inside = "*/" not in bare
        elif slashes and "//" in bare or hashes and (bare.startswith("#") or "# " in bare):
            comments += 1
        elif blocks and bare.startswith("/*"):
            comments += 1
            inside = "*/" not in bare
    loc = len(lines)
    return loc, max(0, loc - comments - blanks - 2), comments, loc - comments


_QUOTED = re.compile(r"\\.?|'(?:\\.|[^'\\])*(?:'|$)|\"(?:\\.|[^\"\\])*(?:\"|$)")


def blank_quotes(line: str) -> str:
    """The line with quoted parts as blanks of the same width (an escaped pair counts as one)."""
    return _QUOTED.sub(lambda m: " " * len(re.sub(r"\\.", " ", m.group(0))), line)


def file_lines(files: DataFrame) -> DataFrame:
    """``(file_id, loc, lloc, cloc, ncloc)`` of each file's text; null text gives nulls."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *(line_counts(t.split("\n"), *MARKERS.get(lang, (True, False, True))) if isinstance(t, str) else (None,) * 4)) for f, lang, t in zip(b["file_id"], b["programming_language"], b["source_text"])]
            yield pd.DataFrame(rows, columns=["file_id", "loc", "lloc", "cloc", "ncloc"]).astype({c: "Int32" for c in ("loc", "lloc", "cloc", "ncloc")})

    return spread(files.select("file_id", "programming_language", "source_text")).mapInPandas(run, "file_id string, loc int, lloc int, cloc int, ncloc int")


def _python_units(text: str) -> list[dict]:
    """Units of Python by its own grammar."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [_unit("error", "Parse error")]
    whole = _counted("file", "", 1, lines=set())
    whole["stop_line"] = text.count("\n") + 1
    out = [whole]
    elifs = {id(n.orelse[0]) for n in ast.walk(tree) if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)}

    def chain(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            inner = chain(n.value)
            return f"{inner}.{n.attr}" if inner else n.attr
        return None

    def count(n: ast.AST, u: dict) -> None:
        if isinstance(n, ast.If):
            u["n_elseif" if id(n) in elifs else "n_if"] += 1
            u["n_else"] += bool(n.orelse) and id(n.orelse[0]) not in elifs
        elif isinstance(n, (ast.For, ast.While, ast.AsyncFor)):
            u["n_loop"] += 1
        elif isinstance(n, ast.Match):
            u["n_switch"] += 1
            u["n_case"] += len(n.cases)
        elif isinstance(n, (ast.operator, ast.unaryop, ast.cmpop, ast.boolop)):
            u["operators"].append(type(n).__name__)
        elif isinstance(n, ast.Call):
            u["operators"].append("()")
            if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id in ("self", "cls"):
                u["calls"].append(n.func.attr)
        elif isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            u["operators"].append("=")
        elif isinstance(n, ast.Constant) and n.value is not None and not isinstance(n.value, bool):
            u["operands"].append(repr(n.value))
        if isinstance(n, (ast.Name, ast.Attribute)):
            name = chain(n) or ""
            if name not in ("self", "cls"):
                u["operands"].append(name.removeprefix("self."))
            if name.startswith("self."):
                u["attributes"].append(name.split(".")[1])

    def visit(n: ast.AST, owner: str | None, u: dict, path: list[str], depth: int) -> None:
        for x in ast.iter_child_nodes(n):
            if isinstance(x, ast.stmt):
                whole["lines"].add(x.lineno)
            if isinstance(x, ast.ClassDef):
                parents = [p for p in map(chain, x.bases) if p]
                c = {**_counted("class", x.name, x.lineno), "stop_line": x.end_lineno, "owner": owner, "parents": parents, "qualified": ".".join([*path, x.name])}
                out.append(c)
                out.extend(_unit("dependency", p.split(".")[-1], owner=x.name, namespace=p, role="extends") for p in parents)
                visit(x, x.name, c, [*path, x.name], 0)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]
                shown = [a.arg + (": " + ast.unparse(a.annotation) if a.annotation else "") for a in args if a.arg not in ("self", "cls")]
                f = {**_counted("function", x.name, x.lineno), "stop_line": x.end_lineno, "owner": owner, "parameters": shown, "qualified": ".".join([*path, x.name])}
                out.append(f)
                visit(x, owner, f, [*path, x.name], 0)
            elif isinstance(x, ast.Import):
                out.extend(_unit("dependency", a.name.split(".")[-1], owner=owner, namespace=a.name, role="import") for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                base = "." * x.level + (x.module or "")
                out.extend(_unit("dependency", a.name, owner=owner, namespace=f"{base}.{a.name}".lstrip("."), role="import") for a in x.names)
            else:
                count(x, u)
                deeper = depth + (isinstance(x, (ast.If, ast.For, ast.While, ast.AsyncFor, ast.Match)) and id(x) not in elifs)
                u["depth"] = max(u["depth"], deeper)
                # a chain of members is one operand
                if isinstance(x, ast.Attribute) and chain(x):
                    continue
                visit(x, owner, u, path, deeper)

    visit(tree, None, whole, [], 0)
    return _with_lines(out, whole.pop("lines"))


def _with_lines(units: list[dict], lines: set[int]) -> list[dict]:
    """Logical lines of each unit: the lines within it on which a statement starts."""
    ordered = sorted(lines)
    for u in units:
        if "start_line" in u:
            u["lloc"] = bisect_right(ordered, u["stop_line"]) - bisect_left(ordered, u["start_line"])
    return units


def _brace_units(language: str) -> LangAdapter:
    """Adapter of a language with braces: one pass over its tokens with a stack of open blocks."""
    line_ends = language in _LINE_ENDS
    hashes = language == "PHP"

    def adapt(text: str) -> list[dict]:
        whole = _counted("file", "", 1)
        out: list[dict] = [whole]
        stack: list[tuple[str, dict, str | None, int]] = []  # kind of block, unit that counts, class, depth
        unit, owner, depth = whole, None, 0
        header: list[str] = []
        lines: set[int] = set()
        namespace = ""
        line, brackets, fresh, previous, skip = 1, 0, True, "", 0
        tokens = _TOKEN.findall(text)
        for t, following in zip(tokens, [*tokens[1:], ""]):
            c = t[0]
            if t == "\n":
                line += 1
                skip = skip if skip > 1 else 0
                if line_ends and brackets == 0 and header and previous not in ("", ",", "(", "=", ":=", "+", "&&", "||", ".", "{") and not (stack and stack[-1][0] == "list"):
                    namespace = _statement(header, out, owner, namespace)
                    header, fresh = [], True
                continue
            if skip or c == "/" and t[:2] in ("//", "/*"):
                line += t.count("\n")
                continue
            if c == "#" and hashes and following != "[":
                skip = 1
                continue
            if fresh and t not in "{}" and brackets == 0:
                lines.add(line)
            fresh = False
            listed = bool(header) and header[0] in ("import", "use")  # names in braces open no block
            if c == "{" and brackets == 0 and not listed:
                kind, made = _block(header, unit, owner, line, language, namespace)
                stack.append((kind, unit, owner, depth))
                if made is not None:
                    out.append(made)
                    unit, depth = made, 0
                    if kind == "class":
                        owner = made["name"]
                        out.extend(_unit("dependency", _last(p), owner=owner, namespace=p, role="extends") for p in made["parents"])
                elif kind == "impl":
                    owner = _impl_name(header)
                elif kind == "namespace":
                    namespace = _namespace_of(header) or namespace
                elif kind == "control":
                    depth += 1
                    unit["depth"] = max(unit["depth"], depth)
                header, fresh = [], True
            elif c == "}" and brackets == 0:
                if header:
                    namespace = _statement(header, out, owner, namespace)
                if stack:
                    unit["stop_line"] = line
                    kind, unit, owner, depth = stack.pop()
                header, fresh = [], True
            elif c == ";" and brackets == 0:
                namespace = _statement(header, out, owner, namespace)
                header, fresh = [], True
            else:
                if c in "([" or c == "{" and listed:
                    brackets += 1
                elif c in ")]" or c == "}" and listed:
                    brackets = max(0, brackets - 1)
                header.append(t)
                _token(t, previous, unit, following == "(")
            if "\n" in t:
                line += t.count("\n")
            previous = t
        for u in [unit, *[x[1] for x in stack]]:
            u["stop_line"] = max(u["stop_line"], line)
        whole["stop_line"] = text.count("\n") + 1
        return _attach(_with_lines(out, lines), language)

    return adapt


#: How a token counts, by its text: a decision's column, "" for nothing, o operator, n literal, w name, e else.
_ACTIONS: dict[str, str] = {**dict.fromkeys(_LOOPS, "n_loop"), **dict.fromkeys(_SWITCHES, "n_switch"), "if": "if", "elseif": "n_elseif", "else": "n_else", "case": "n_case", **dict.fromkeys([*"(){}[];,.#@", "..", "...", "..="], "")}
_ACTIONS.update({k: "" for k in _KEYWORDS if k not in _ACTIONS})


def _token(t: str, previous: str, u: dict, called: bool) -> None:
    """Count one token on its unit: decisions, operators and operands."""
    action = _ACTIONS.get(t)
    if action == "":
        return
    c = t[0]
    if action is None:
        if c.isalpha() or c in "_$@":
            whole = "".join(t.split()) if " " in t or "\n" in t or "\t" in t else t
            short = _SELF.sub("", whole) if c in "$tsbp" else whole
            if short is not whole and short != whole:
                u["calls" if called else "attributes"].append(re.split(r"\.|->|::", short)[0])
            if called:
                u["operators"].append("()")
            u["operands"].append(short)
        elif c.isdigit() or c in "\"'`":
            u["operands"].append(t)
        else:
            u["operators"].append(t)
            if t == "=>" and u["n_switch"]:
                u["n_case"] += 1
    elif action == "if":
        u["n_elseif" if previous == "else" else "n_if"] += 1
        u["n_else"] -= previous == "else"
    else:
        u[action] += 1


_NAMES = re.compile(r"[A-Za-z_][\w\\.:]*")


def _last(name: str) -> str:
    return re.split(r"\\|::|\.|/", name.strip("\"'"))[-1]


def _block(header: list[str], unit: dict, owner: str | None, line: int, language: str, namespace: str) -> tuple[str, dict | None]:
    """Kind of the block that ``header`` opens, and the unit it makes, if any."""
    words = [t for t in header if t not in _MODIFIERS]
    first = words[0] if words else ""
    if first == "<" or first == "?":  # PHP's opening tag before the first statement
        words = [w for w in words if w not in ("<", "?", "php")]
        first = words[0] if words else ""
    if first in ("namespace", "mod"):
        return "namespace", None
    if first == "impl":
        return "impl", None
    if first == "type" and len(words) >= 3 and words[2] in ("struct", "interface"):
        return "class", _class(words[1], words[2], [], line, namespace)
    if first in _CLASSES and len(words) >= 2:
        rest = words[2:]
        cut = next((i for i, w in enumerate(rest) if w in ("extends", "implements", ":")), None)
        parents = [w for w in rest[cut:] if _NAMES.fullmatch(w) and w not in _KEYWORDS] if cut is not None else []
        return "class", _class(words[1].split("<")[0], first, parents, line, namespace)
    if first in _CONTROL:
        return "control", None
    at = words.index("(") if "(" in words else -1
    if first in ("func", "function", "fn") or "function" in words[:4] or "fn" in words[:3] or (
        at >= 1 and owner is not None and unit["kind"] == "class" and _NAMES.fullmatch(words[at - 1]) and words[at - 1] not in _KEYWORDS and "=" not in words[:at] and "new" not in words[:at]
    ):
        receiver = None
        if first == "func" and at == 1:  # Go method: the receiver's type owns it
            close = words.index(")") if ")" in words else at
            receiver = next((w.lstrip("*") for w in reversed(words[at:close]) if _NAMES.fullmatch(w)), None)
            at = next((i for i in range(close + 1, len(words)) if words[i] == "("), -1)
        elif first in ("func", "function", "fn"):
            at = next((i for i in range(1, len(words)) if words[i] == "("), -1)
        name = words[at - 1] if at >= 1 and _NAMES.fullmatch(words[at - 1]) and words[at - 1] not in ("function", "func", "fn") else None
        if name is None:
            return "block", None  # a closure counts on the function around it
        deep, parameters, now = 0, [], []
        for w in words[at:]:
            deep += (w in "([") - (w in ")]")
            if deep == 0:
                break
            if w == "," and deep == 1:
                parameters.append(" ".join(now))
                now = []
            elif not (w == "(" and deep == 1):
                now.append(w)
        parameters = [p for p in [*parameters, " ".join(now)] if p and p.replace("& ", "").replace("mut ", "") not in ("self", "this")]
        f = {**_counted("function", name, line), "owner": receiver or owner, "receiver": receiver is not None, "parameters": parameters}
        f["qualified"] = _join(namespace, receiver or owner, name)
        f["public"] = name[0].isupper() if language == "Golang" else "private" not in header and "protected" not in header and not name.startswith("_")
        return "function", f
    return ("block" if words else "list"), None


def _join(*parts: str | None) -> str:
    return ".".join(re.sub(r"\\|::", ".", p) for p in parts if p)


def _class(name: str, word: str, parents: list[str], line: int, namespace: str) -> dict:
    c = _counted("interface" if word == "interface" else "class", name, line)
    return {**c, "parents": parents, "namespace": namespace or None, "qualified": _join(namespace, name)}


def _impl_name(header: list[str]) -> str | None:
    names = [t for t in header[header.index("impl") + 1 :] if _NAMES.fullmatch(t)]
    return names[names.index("for") + 1] if "for" in names and names.index("for") + 1 < len(names) else names[0] if names else None


def _namespace_of(header: list[str]) -> str | None:
    return next((t for t in header if _NAMES.fullmatch("".join(t.split())) and t not in ("namespace", "mod", "package", "php") and t not in _MODIFIERS), None)


def _statement(header: list[str], out: list[dict], owner: str | None, namespace: str) -> str:
    """A statement that opened no block: imports become dependencies; a package or namespace is returned."""
    words = [t for t in header if t not in ("<", "?", "php")] if header[:2] == ["<", "?"] else header
    first = words[0] if words else ""
    if first in ("package", "namespace"):
        return _namespace_of(words) or namespace
    if first in ("import", "use", "using", "from", "require", "include", "require_once", "include_once"):
        quoted = [t.strip("\"'`") for t in words if t[0] in "\"'`"]
        names = ["".join(t.split()) for t in words[1:] if _NAMES.fullmatch("".join(t.split()).lstrip("\\")) and t not in _KEYWORDS | {"from"}]
        if first == "import" and quoted:
            if names and not any(t == "(" for t in words):  # import { A, B } from "x"
                out.extend(_unit("dependency", n, owner=owner, namespace=quoted[-1], role="import") for n in names)
            else:
                out.extend(_unit("dependency", _last(q), owner=owner, namespace=q, role="import") for q in quoted)
        elif quoted:
            out.extend(_unit("dependency", _last(q), owner=owner, namespace=q, role="import") for q in quoted)
        elif names:
            out.append(_unit("dependency", _last(names[0]), owner=owner, namespace=_join(names[0].replace("crate::", "")), role="import"))
    return namespace


def _attach(units: list[dict], language: str) -> list[dict]:
    """Types a function makes (``new X``) as dependencies, and Go methods by their receiver's struct."""
    classes = {u["name"]: u for u in units if u["kind"] in ("class", "interface")}
    for u in units:
        if u["kind"] == "function" and u.get("receiver") and u["owner"] in classes:
            u["qualified"] = _join(classes[u["owner"]].get("qualified") or u["owner"], u["name"])
    return units


#: Adapter of each language; further ones may be added.
ADAPTERS: dict[str, LangAdapter] = {"Python": _python_units, **{x: _brace_units(x) for x in ("Golang", "PHP", "Rust", "TypeScript", "Java", "C#")}}

UNIT_SCHEMA = (
    "file_id string, kind string, name string, owner string, namespace string, qualified string, role string, start_line int, stop_line int, loc int, lloc int, cloc int, "
    "n_if int, n_elseif int, n_else int, n_loop int, n_case int, n_switch int, depth int, n_operators int, n_distinct_operators int, n_operands int, n_distinct_operands int, n_parameters int, "
    "public boolean, operators array<string>, operands array<string>, calls array<string>, attributes array<string>, parameters array<string>, parents array<string>"
)


def comment_lines(text: str, language: str | None) -> list[int]:
    """Numbers of the lines that ``line_counts`` takes for comments."""
    slashes, hashes, blocks = MARKERS.get(language, (True, False, True))
    out, inside = [], False
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if not line:
            continue
        bare = blank_quotes(line) if '"' in line or "'" in line or "\\" in line else line
        if inside:
            out.append(n)
            inside = "*/" not in bare
        elif slashes and "//" in bare or hashes and (bare.startswith("#") or "# " in bare):
            out.append(n)
        elif blocks and bare.startswith("/*"):
            out.append(n)
            inside = "*/" not in bare
    return out


def extract_units(files: DataFrame, adapters: dict[str, LangAdapter] | None = None) -> DataFrame:
    """Rows of every file, class, interface, function, dependency and parse error of each file (``UNIT_SCHEMA``).

    Python is read by its own grammar, other languages by their tokens and blocks; languages without an adapter as
    TypeScript.  Decisions are counted on the innermost function (or class, or file) around them; boolean operators are
    none.  lloc counts the lines on which a statement starts, depth how deep decisions nest; operators and operands are
    distinct lists.  Methods of Go receivers belong to their struct.  Null and empty texts give no rows; a text that an
    adapter can't read gives one row of kind error.
    """
    names = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]
    table = {**ADAPTERS, **(adapters or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, lang, text in zip(b["file_id"], b["programming_language"], b["source_text"]):
                if not isinstance(text, str) or not text:
                    continue
                text = text.replace("\r\n", "\n")
                try:
                    units = table.get(lang, table["TypeScript"])(text)
                except (ValueError, IndexError, RecursionError):
                    units = [_unit("error", "Parse error")]
                comments = comment_lines(text, lang)
                for u in units:
                    counted = "start_line" in u
                    ops, opd = u.get("operators", []), u.get("operands", [])
                    start, stop = u.get("start_line"), u.get("stop_line")
                    cloc = bisect_right(comments, stop) - bisect_left(comments, start) if counted else None
                    sized = (len(ops), len(set(ops)), len(opd), len(set(opd)), len(u["parameters"])) if counted else (None,) * 5
                    lists = tuple(list(dict.fromkeys(u[k])) for k in ("operators", "operands", "calls", "attributes")) + (u["parameters"], u["parents"]) if counted else (None,) * 6
                    rows.append((f, u["kind"], u["name"], u.get("owner"), u.get("namespace"), u.get("qualified"), u.get("role"), start, stop, stop - start + 1 if counted else None, u.get("lloc"), cloc,
                                 *(u.get(k) for k in _DECISIONS), u.get("depth"), *sized, u.get("public", True if u["kind"] == "function" else None), *lists))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names[7:24]})

    return spread(files.select("file_id", "programming_language", "source_text")).mapInPandas(run, UNIT_SCHEMA)


def resolve_dependencies(units: DataFrame, files: DataFrame) -> DataFrame:
    """``(repo, file_id, from_class, namespace, class_name, to_file, to_class)`` of every distinct dependency of a file.

    A dependency is looked up by its namespace among the qualified names of the repo's classes, then by its class name among
    the qualified and short ones (left joins, so what is not resolved stays, with nulls).  Of several owners the smallest
    file_id counts.  ``files(file_id, repo)`` names the repo.
    """
    u = cut_lineage(units.where(F.col("kind").isin("class", "interface", "dependency")).select("file_id", "kind", "name", "owner", "namespace", "qualified").join(files.select("file_id", "repo"), "file_id"))
    classes = u.where("kind <> 'dependency' and name is not null")
    found = F.min(F.struct("file_id", F.col("name").alias("class")))
    by_full = classes.where("qualified is not null").groupBy("repo", F.col("qualified").alias("full")).agg(found.alias("by_full"))
    by_name = classes.select("repo", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified")))).alias("short"), "file_id", "name").groupBy("repo", "short").agg(found.alias("by_name"))
    asked = u.where("kind = 'dependency'").select("repo", "file_id", F.col("owner").alias("from_class"), "namespace", F.col("name").alias("class_name")).distinct()
    dotted = F.regexp_replace("namespace", r"\\\\|::", ".")
    joined = asked.withColumn("full", dotted).join(by_full, ["repo", "full"], "left").join(by_name.withColumnRenamed("short", "class_name"), ["repo", "class_name"], "left")
    hit = F.coalesce("by_full", "by_name")
    return joined.select("repo", "file_id", "from_class", "namespace", "class_name", hit.getField("file_id").alias("to_file"), hit.getField("class").alias("to_class"))


def file_dependencies(units: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, other, direction)``: the files that own what a file depends on, and the relation inverted; a file's own classes are dropped."""
    found = resolve_dependencies(units, files).where("to_file <> file_id").select("file_id", F.col("to_file").alias("other")).distinct()
    found = cut_lineage(found)
    return found.withColumn("direction", F.lit("efferent")).unionByName(found.select(F.col("other").alias("file_id"), F.col("file_id").alias("other"), F.lit("afferent").alias("direction")))


def distinct_units(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first unit of each key in each file: units attached twice count once."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id", *keys).orderBy(order)
    return units.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
