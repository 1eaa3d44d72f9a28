"""Source files that do not parse: token pairs, nesting and statement productions as DataFrame rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm.grammar import LEFT, LINE_REDUCTIONS, REDUCTIONS, adjacent
from codeweft.session import cut_lineage, spread

#: Extension -> grammar.
GRAMMARS = {"go": "go", "php": "php", "py": "python", "rs": "rust", "ts": "ts", "tsx": "ts", "mts": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "java": "java", "cs": "cs"}

# Classes of tokens, one character each:
#   i name   n number   s string   v PHP variable   ( ) [ ] { } , ; : . ? @ # themselves   = assignment
#   b binary operator   m sign that may be unary or binary   ! prefix operator   < > themselves   p ++ or --
#   a ->   A =>   d ::   e .. or ...   L line end   Z what no token of the language may be
#   Q if   q else-if   E else   W while (Go: for)   D do (Rust: loop)   T try   K catch   Y finally   P other keyword before a parenthesis
#   G for, match and the like without one   R return, throw and the like   C class-like   F function   I import   k package
#   j lifetime   V let, var, const   M modifier   X infix keyword   N prefix keyword   H text outside PHP tags   ^ start of file   $ its end

_WORDS = {  # keywords of each grammar by class (fixed values)
    "java": {"P": "for switch synchronized", "Q": "if", "W": "while", "K": "catch", "R": "return throw assert", "E": "else", "D": "do", "T": "try", "Y": "finally", "C": "class interface enum", "I": "import", "k": "package",
             "M": "public private protected static final abstract native transient volatile strictfp default sealed non-sealed record permits", "X": "extends implements throws instanceof", "N": "new case yield"},
    "cs": {"P": "for foreach switch lock fixed", "Q": "if", "W": "while", "K": "catch", "R": "return throw", "E": "else", "D": "do", "T": "try", "Y": "finally", "C": "class interface enum struct", "I": "using namespace",
           "M": "public private protected internal static sealed abstract virtual override readonly partial async extern volatile const event ref out in params this operator implicit explicit record unmanaged global required file scoped get set init add remove when where unsafe checked unchecked", "X": "is as", "N": "new await typeof sizeof nameof case goto yield default stackalloc delegate"},
    "php": {"P": "for foreach switch declare isset empty array list unset exit die", "Q": "if", "q": "elseif", "W": "while", "K": "catch", "R": "return throw echo print include include_once require require_once yield global goto break continue", "E": "else", "D": "do", "T": "try", "Y": "finally", "C": "class interface trait enum", "F": "function fn", "I": "use namespace", "V": "const",
            "M": "public private protected static final abstract readonly var", "X": "extends implements instanceof as insteadof and or xor", "N": "new clone case default match"},
    "ts": {"P": "switch with for", "Q": "if", "W": "while", "K": "catch", "R": "return throw", "E": "else", "D": "do", "T": "try", "Y": "finally", "C": "class interface enum", "F": "function", "I": "import", "V": "let const var",
           "M": "export default public private protected static readonly abstract declare async get set override type namespace module accessor asserts infer keyof unique break continue debugger", "X": "extends implements instanceof in of as is satisfies from", "N": "new await typeof void delete case yield"},
    "go": {"Q": "if", "W": "for", "G": "switch select", "R": "return go defer break continue goto fallthrough", "E": "else", "C": "struct interface", "F": "func", "I": "import", "k": "package", "V": "var const type", "X": "range chan map case default"},
    "rust": {"Q": "if", "W": "while", "G": "for match", "D": "loop", "R": "return break continue", "E": "else", "C": "struct enum trait union", "F": "fn", "I": "use mod crate_", "V": "let const static type", "M": "pub unsafe extern async mut ref move impl dyn where default", "X": "in as", "N": "box await_"},
    "python": {"Q": "if", "q": "elif", "W": "while", "G": "for with match_ case_", "K": "except", "T": "try", "Y": "finally", "R": "return raise assert del global nonlocal pass break continue print_", "E": "else", "C": "class", "F": "def", "I": "import from", "M": "async", "X": "in is and or as", "N": "not lambda await yield"},
}
_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_NUMBER = r"\.?\d(?:[eEpP][+-]?[\w.]|\.(?=\d|[^.\w]|$)|\w|_)*"
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_OPERATORS = r"\.\.\.|\.\.=?|->|=>|::|\+\+|--|<=>|===|!==|==|!=|<=(?!>)|>=|&&=?|\|\|=?|\?\?=?|<<=?|>>>?=|\*\*=?|:=|<-|[-+*/%&|^.]=|\?->|\?\."
_NAME = r"[^\W\d]\w*"
#: Tokens by grammar; what matches none of them is one character of class Z.
_TOKENS = {
    "java": rf'{_C_COMMENT}|"""[\s\S]*?"""|{_STRING}|[^\W\d][\w$]*|{_NUMBER}|{_OPERATORS}|\n|\S',
    "cs": rf'{_C_COMMENT}|(?m:^[ \t]*#[ \t]*(?:if|else|elif|endif|region|endregion|pragma|define|undef|nullable|line|error|warning)\b[^\n]*)|"""[\s\S]*?"""|\$?@\$?"(?:""|[^"])*"|\$"(?:\\.|[^"\\\n])*"|{_STRING}|@?[^\W\d]\w*|{_NUMBER}|{_OPERATORS}|\n|\S',
    "php": rf'\?>[\s\S]*?(?:<\?php\b|<\?=|$(?![\s\S]))|{_C_COMMENT}|#(?!\[)[^\n]*|<<<[ \t]*["\']?\w+["\']?\n(?:[^\n]*\n)*?[ \t]*\w+(?=[;,)\n])(?<=[A-Z])|"(?:\\[\s\S]|[^"\\])*"|\'(?:\\[\s\S]|[^\'\\])*\'|\$+[^\W\d]\w*|\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*\\?|{_NUMBER}|{_OPERATORS}|\n|\S',
    "ts": rf'\A#![^\n]*|{_C_COMMENT}|`(?:\\[\s\S]|\$\{{(?:[^{{}}`]|`[^`]*`|\{{[^{{}}]*\}})*\}}|[^`\\])*`|{_STRING}|(?:(?<=[=(,:!&|?{{}};\[\n])|(?<=[=(,:!&|?{{}};\[] ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|[#@]?[$\w]*[^\W\d][$\w]*|\$+|{_NUMBER}|{_OPERATORS}|\n|\S',
    "go": rf'{_C_COMMENT}|`[^`]*`|{_STRING}|{_NAME}|{_NUMBER}|{_OPERATORS}|\n|\S',
    "rust": rf'{_C_COMMENT}|b?r"[^"]*"|b?r#"[\s\S]*?"#|b?r##"[\s\S]*?"##|b?"(?:\\[\s\S]|[^"\\])*"|b?\'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^\'\\\n])\'|\'[^\W\d]\w*|r#\w+|\$?{_NAME}|{_NUMBER[3:]}|{_OPERATORS}|\n|\S',
    "python": rf'(?<=\n)[ \t]+(?=[^\s#])|\A[ \t]+(?=[^\s#])|#[^\n]*|(?i:[rbuf]{{0,2}})(?:"""(?:\\[\s\S]|[^\\])*?"""|\'\'\'(?:\\[\s\S]|[^\\])*?\'\'\')|(?i:[rbuf]{{0,2}})(?:"(?:\\[\s\S]|[^"\\\n])*"|\'(?:\\[\s\S]|[^\'\\\n])*\')|{_NAME}|{_NUMBER}|->|\*\*=?|//=?|:=|<<=?|>>=?|[-+*/%&|^@=!<>]=|\.\.\.|\\\n|\n|\S',
}
_CONFLICT = r"(?m:^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$)[^\n]*)"
_SIGNS = {
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", ",": ",", ";": ";", ":": ":", ".": ".", "?": "?", "@": "@", "=": "=", "!": "!", "~": "!", "<": "<", ">": ">", "+": "m", "-": "m", "*": "m", "&": "m",
    "/": "b", "%": "b", "|": "b", "^": "b", "==": "b", "!=": "b", "===": "b", "!==": "b", "<=": "b", ">=": "b", "&&": "b", "||": "b", "??": "b", "<<": "b", ">>": "b", "<=>": "b", "**": "m", ":=": "=", "<-": "m",
    "++": "p", "--": "p", "->": "a", "=>": "A", "::": "d", "..": "e", "...": "e", "..=": "e", "?->": "a", "?.": ".", "\n": "L", "#": "#",
} | {x: "=" for x in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", ".=", "&&=", "||=", "??=", "<<=", ">>=", ">>>=", "**=", "//=", "@=")}
#: Signs that are no token of a grammar (fixed values).
_ALIEN = {
    "java": ["#", ":=", "=>", "===", "!==", "??", "..", "**", "<-", "?.", "`"], "go": ["#", "@", "?", "=>", "->", "::", "===", "!==", "??", "**", "..", "?.", "?->"],
    "rust": ["===", "!==", "??", ":=", "<=>", "**", "++", "--"], "cs": [":=", "===", "!==", "<=>", "**=", "<-", "#"], "php": [":=", "<-", ".."], "ts": ["->", "::", ":=", "<-", "..", "<=>", "#"],
    "python": ["?", "!", "$", "++_", "&&", "||", "=>", "::", "===", "`"],
}


@lru_cache(maxsize=16)
def _lexer(grammar: str, marks: bool) -> tuple[re.Pattern, dict[str, str]]:
    """Token pattern (conflict marks first, for texts that hold any) and the class of each fixed token."""
    pattern = _TOKENS[grammar]
    # names are most of all tokens; where no string starts like one, they are tried first
    first = r"[^\W\d]\w*(?![\w$\\])|" if grammar in ("java", "go", "php", "ts") else ""
    body = (r"\A#![^\n]*|" if grammar == "ts" else "") + (_CONFLICT + "|" if marks else "") + first + pattern
    pattern = re.compile(body if grammar == "python" else rf"[^\S\n]*({body})")
    table = dict(_SIGNS)
    for sign in _ALIEN[grammar]:
        table[sign] = "Z"
    if grammar == "php":
        table["."] = "b"
        table["@"] = "!"
    if grammar == "python":
        table |= {"**": "m", "//": "b", "@": "m", "*": "m"}
    for cls, words in _WORDS[grammar].items():
        for w in words.split():
            table[w] = cls
    return pattern, table


def _class_of(token: str, grammar: str) -> str:
    """Class of a token that is no fixed one; '' for blanks and comments."""
    c = token[0]
    if c.isspace() or c == "\ufeff":
        return "" if "\n" not in token or token == "\\\n" or c != "\n" and "/" not in token else ""
    if token[:2] in ("//", "/*") and (grammar != "python"):
        return ""
    if c == "#" and len(token) > 1 and grammar in ("php", "python", "cs") or token[:2] == "#!":
        return ""
    if len(token) > 6 and token[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
        return "Z"
    if c == "'" and grammar == "rust" and not token.endswith("'"):
        return "j"
    if c in "\"'`" or token[-1] in "\"'`" and len(token) > 1:
        return "s" if len(token) > 1 else "Z"
    if c == "<" and token.startswith("<<<"):
        return "s"
    if token.startswith("?>"):
        return "H"
    if c == "/" and len(token) > 1:
        return "s"  # a regular expression
    if c == "\\" and token == "\\\n":
        return ""
    if c == "$" and grammar == "php":
        return "v" if len(token) > 1 else "Z"
    if c == "$" and grammar == "rust":  # of macros
        return "i" if len(token) > 1 else ""
    if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
        return "n"
    if c == "@" and grammar == "ts":
        return "@"
    if c.isalpha() or c in "_$@#\\" and len(token) > 1 or c == "_" or c == "$" and grammar in ("ts", "java"):
        return "i"
    return "Z"


#: Words that are keywords only in a construct of theirs; they count where the text holds one.
_CONTEXTUAL = {
    "python": [(re.compile(r"(?m)^[ \t]*match\b[^=\n]*:[ \t]*(?:#.*)?$"), {"match": "G", "case": "G"})],
    "cs": [(re.compile(r"\bfrom\s+(?:\w+\s+)?\w+\s+in\b"), dict.fromkeys("from where orderby select group by into join on equals let ascending descending".split(), "X"))],
}
#: Keywords that are names after a point: all in TypeScript and PHP, none in Go and Python.
_MEMBER_CODE = {g: re.compile(r"([.ad])[PGRECFIkVMXNQqWDTKY]") for g in ("ts", "php")} | {"java": re.compile(r"(\.)[CMN]"), "cs": re.compile(r"(\.)[M]"), "rust": re.compile(r"([.d])[NMI]")}


#: Classes of the tokens that a process has seen, by grammar; a table that has grown beyond KNOWN_TOKENS starts anew.
_KNOWN: dict[str, dict[str, str]] = {g: {} for g in _TOKENS}
KNOWN_TOKENS = 200_000


def lex(text: str, grammar: str) -> tuple[str, list[str]]:
    """Classes of the tokens of ``text`` as a string, line ends kept as L, and the tokens themselves."""
    pattern, table = _lexer(grammar, "<<<<<<<" in text or "=======" in text or ">>>>>>>" in text)
    if text[:1] == "\ufeff":
        text = text[1:]
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lead = ""
    if grammar == "php":
        at = re.search(r"<\?php\b|<\?=", text)
        if at is None:
            return "H", []
        text, lead = text[at.end():], "H"
    tokens = pattern.findall(text)
    known = _KNOWN[grammar]
    if len(known) > KNOWN_TOKENS:
        known.clear()
    for found, words in _CONTEXTUAL.get(grammar, ()):
        if found.search(text):
            table = table | words
            known = {}
    new = set(tokens).difference(known)
    for t in new:  # every distinct token once
        c = table.get(t)
        if c is None:
            c = _class_of(t, grammar)
            if c == "" and "\n" in t and t != "\\\n":
                c = "L" * t.count("\n")
            elif c == "s" and "\n" in t and grammar != "python":
                c = "s" + "\x01" * t.count("\n")  # lines inside a string still count
        known[t] = c
    codes = "".join(map(known.__getitem__, tokens))
    for t in new:
        if len(t) > 100:  # long texts are not kept
            del known[t]
    if grammar in _MEMBER_CODE:
        codes = _MEMBER_CODE[grammar].sub(r"\1i", codes)
    return lead + codes, tokens


#: What no statement of a grammar looks like, over classes where calls are c, other groups g and the brackets of control headers are
#: gone (Java, C#, PHP, Rust), or over plain classes: three names in a row, a return or an import that nothing ends, an operand
#: behind a call or another operand where a semicolon is missing, a header without its colon.
_BAD_STATEMENTS = {
    "java": r"iii|^R[^;{}]*\}$|c[insRVQWTDGPCF]|=[insc.bmg!]*[insc][insPQWTDRKM]|^I[^;]*[{}]|^I.[^;]*[IkCM]|^k[^;]*[IkC]",
    "cs": r"iii|^R[^;{}]*\}$|iid|c[insRQWTDGCF]|=[insc.bmg!]*[insc][insQWTDR]|^I[^;{cg]*\}|^I[^;{]*[IC]",
    "php": r"^R[^;{}]*\}$|c[insvRQWTDGCFN]|=[insvc.bmg!a]*[insvc][nsvM]|^I[^;{]*[IC]",
    "rust": r"^I[^;{]*\}$|c[insVRW]",
    "ts": r"^I[^s(=.{]*$|^C[^{;]*;",
    "go": r"iii|^I[^(s]*$|^I[^(]*;|^W[^{};]*;[^{};]*\{",
    "python": r"^[GEFCQqWTKY][^:]*$|^(?![GEFCMQqWTKY@])[^:\[({N]*:$|^F(?!i\()|^Mi|^[^I].*m$|^[GEFCQqWTKY][^\[]*::",
}
#: Grammars in which every statement of a block must have an end.
_STRICT = frozenset(("java", "cs", "php"))
_LEFT_OVER = re.compile(r"[^;BQqEWDTKYU]+")
_CONTROL = re.compile(r"([PQWKGqT])\([^()]*\)")
_CALL = re.compile(r"(?<=[icC>\]sN])\([^()]*\)")
_GROUP = re.compile(r"\([^()]*\)")
_INDEX = re.compile(r"(?<=[icg>s])\[[^\[\]()]*\]")
_LIST = re.compile(r"\[[^\[\]()]*\]")
_INNER = re.compile(r"([^;{}B]*)\{([^{}]*)\}")
#: A control keyword whose body comes next, and a header such as that of a for at the start of a statement.
_HEADED = re.compile(r"[QEWDTKYGU][^=]*$|[aA]$")
_HEADER = re.compile(r"(?<=[;{}BEWPQD])P")
_CASE = re.compile(r"(?<=[;{}B])(?:N[^;{}]*?|M):")
_LABEL = re.compile(r"(?<=[;{}B])i:(?=[QWDPG{])")


def _flat(stream: str, grammar: str) -> str:
    """The classes with brackets taken out from within: calls are c, other groups g; a try with resources is U."""
    size = -1
    while size != len(stream) and ("(" in stream or "[" in stream):
        size = len(stream)
        stream = _CONTROL.sub(lambda m: "U" if m.group(1) == "T" else m.group(1), stream)
        stream = _GROUP.sub("g", _CALL.sub("c", stream))
        stream = _LIST.sub("g", _INDEX.sub("", stream))
    if grammar == "java":  # annotations
        stream = re.sub(r"@i(?:\.i)*c?", "", stream)
    elif grammar == "rust":  # guards of arms, and let with else
        stream = re.sub(r"Q(?=[^{};A]*A)", "s", re.sub(r"#!?g", "", stream))
        stream = re.sub(r"(V[^;{}QEWG]*)E", r"\1s", stream).replace("D", "s")
    return stream


def _contents(flat: str, grammar: str) -> set[str]:
    """What is left of each block when its inner blocks are taken out, marked with what may be left in the end.

    Braces that hold values (of an assignment, an initialiser, arms) are part of their statement and no block.
    """
    strict = grammar in _STRICT
    end = ";" if grammar == "ts" else ""  # the last statement of a block needs none
    if strict or grammar == "ts":
        flat = _HEADER.sub("W", _LABEL.sub("", _CASE.sub("", flat)))
    found: set[str] = set()

    def reduce(m: re.Match) -> str:
        header, content = m.group(1), m.group(2)
        plain = ";" not in content and "B" not in content and _HEADED.search(header) is None
        if plain and (header[-1:] in ("=", ",", "g", "?", "b", "m", "]", "") or "N" in header or "=" in header or "A" in content) or not strict and header[-1:] in (":", "=", ",", "?"):
            if header or not strict or grammar != "php":
                if content and (header or content.strip("s,") != ""):
                    return header + "s"
        if content:
            found.add(("strict|" if strict and "C" not in header else "loose|") + _LEFT_OVER.sub("s", content) + end)
        return header + "B"

    size = -1
    while size != len(flat):
        size = len(flat)
        flat = _INNER.sub(reduce, flat)
    if "{" not in flat and "}" not in flat:
        found.add("loose|" + _LEFT_OVER.sub("s", flat.strip("^$H")) + end)
    return found


#: Lines whose brackets are reduced together before they become rows.
CHUNK_LINES = 64


def _reduced(brackets: str) -> str:
    """What a run of brackets leaves open: pairs that meet vanish, in one place after the other."""
    size = -1
    while len(brackets) != size:
        size = len(brackets)
        brackets = brackets.replace("()", "").replace("[]", "").replace("{}", "")
    return brackets


def rows_of(text: str, grammar: str) -> list[tuple[str, str, str, int]]:
    """``(kind, a, b, place)`` rows of one file.

    p: its distinct token pairs, two characters each, and l those that a line end of TypeScript parts; s: its distinct statements,
    one a line; c: its distinct contents of blocks; b: brackets that a chunk of lines leaves open; i: indentation of a Python
    line and whether it opens a block; e: an error.
    """
    codes, tokens = lex(text, grammar)
    plain = codes.replace("\x01", "")
    out: list[tuple[str, str, str, int]] = []
    if "\x00" in text:  # no language has such a character in its source, strings and comments included
        out.append(("e", "NUL", "", 0))
    if "Z" in plain:
        out.append(("e", "Z", "", plain.index("Z")))
    lines = re.sub(r"[^()\[\]{}L\x01]+", "", codes).replace("\x01", "L").split("L")
    for n in range(0, len(lines), CHUNK_LINES):
        rest = _reduced("".join(lines[n : n + CHUNK_LINES]))
        if rest:
            out.append(("b", rest, "", n))
    if grammar == "python":
        stream = _significant(plain, grammar).strip("L")
        framed = "^" + stream + ("L" if stream else "") + "$"
        statements = {x for x in stream.split("L") if x}
        rows, contents = _indents(tokens)
        out += rows
    else:
        if grammar == "go":  # a line end behind an operand, a closing bracket or a jump is a semicolon
            stream = re.sub(r"(?<=[insvpR)\]}])L+", ";", plain + "L").replace("L", "")
        elif grammar == "ts":
            stream = re.sub("L+", "L", plain).strip("L")
        else:
            stream = plain.replace("L", "")
        framed = "^" + stream + "$"
        if grammar in ("go", "ts"):
            parts = set(re.findall(r"[^;{}L]*[;{}L]", stream.replace("L", "L") + "L"))
            if grammar == "go":
                parts |= set(re.findall(r"W[^{};]*;[^{}]*\{", _flat(stream, grammar)))
                parts = {x for x in parts if not re.match(r"W[^{};]*;[^{};]*;[^{};]*\{", x)}
            flat = _flat(re.sub(r"(?<=[insvcgpM)\]R}])L(?![.?:bm=<>{,)A])", ";", stream).replace("L", ""), grammar)
            if grammar == "go":  # clauses of headers are no statements
                flat = re.sub(r"[QWG][^{}]*\{", lambda m: m.group(0).replace(";", ""), flat)
        else:
            flat = _flat(stream, grammar)
            parts = set(re.findall(r"[^;{}]*[;{}]", flat))
        statements = {x.rstrip("L") for x in parts if len(x) > 1}
        contents = set() if grammar == "php" and _ALTERNATIVE.search(text) else _contents(flat, grammar)
    if grammar == "ts":
        parted = {framed[m.start() - 1] + framed[m.end()] for m in re.finditer("L", framed)}
        out.append(("l", "".join(parted), "", 0))
        pairs = {a + b for a, b in set(zip(framed, framed[1:])) if a != "L" and b != "L"}
    else:
        pairs = {a + b for a, b in set(zip(framed, framed[1:]))}
    out.append(("p", "".join(pairs), "", 0))
    if statements:
        out.append(("s", "\n".join(statements), "", 0))
    if contents:
        out.append(("c", "\n".join(contents), "", 0))
    return out


#: PHP's control structures without braces, whose blocks are not taken apart.
_ALTERNATIVE = re.compile(r"\bend(?:if|while|for|foreach|switch)\b")


def _significant(codes: str, grammar: str) -> str:
    """Runs of line ends made one, and for Python those inside brackets left out."""
    out, depth = [], 0
    if grammar != "python":  # a line end may end a statement there too, as in import ( ... )
        return re.sub("L+", "L", codes)
    inside, closing = "([{", ")]}"
    for run in re.split(r"([()\[\]{}])", codes):
        if run in inside and run:
            depth += 1
        elif run in closing and run:
            depth = max(0, depth - 1)
        elif depth and "L" in run:
            run = run.replace("L", "")
        out.append(run)
    return re.sub("L+", "L", "".join(out))


#: First words of Python's compound statements.
_HEADS = {"if": "Q", "elif": "q", "else": "E", "while": "W", "for": "G", "with": "G", "try": "T", "except": "K", "finally": "Y", "async": "G"}


def _indents(tokens: list[str]) -> tuple[list[tuple[str, str, str, int]], set[str]]:
    """Logical lines of Python at which the indentation changes or must: width, and whether the line opens a block; and the distinct
    sequences of first words of the lines of each block."""
    out, depth, stack = [], 0, [0]
    width, last, start, n, head = 0, "", True, 0, "s"
    previous = False
    blocks: list[str] = [""]
    contents: set[str] = set()

    def close() -> bool:
        opens = last == ":"
        if opens or previous or width != stack[-1]:
            out.append(("i", str(width), "1" if opens else "0", n))
        if width > stack[-1]:
            stack.append(width)
            blocks.append("")
        while width < stack[-1]:
            stack.pop()
            contents.add("lines|" + blocks.pop())
        if width != stack[-1]:
            out.append(("e", "dedent", "", n))
            stack.append(width)
            blocks.append("")
        if head != "s" or blocks[-1][-1:] != "s":
            blocks[-1] += head
        return opens

    for t in tokens:
        if t == "\n":
            if depth == 0:
                if not start:
                    previous = close()
                    n += 1
                start, width, last = True, 0, ""
        elif t[0] in " \t":
            if start and depth == 0:
                width = len(t.expandtabs(8))
        elif t[0] == "#" or t == "\\\n":
            continue
        else:
            if start:
                head = _HEADS.get(t, "s")
            start, last = False, t
            if len(t) == 1:
                if t in "([{":
                    depth += 1
                elif t in ")]}":
                    depth = max(0, depth - 1)
    if not start:
        close()
        n += 1
    out.append(("i", "0", "0", n))
    return out, contents | {"lines|" + b for b in blocks}


def permitted_pairs(spark: SparkSession) -> DataFrame:
    """``(grammar, kind, a, ok)`` with the pair in ``a``, of all grammars: at most 8 * 60 * 60 rows.

    The pairs are derived from each grammar's productions.  A line end of TypeScript may stand for a semicolon (kind l).
    """
    rows = []
    for g in _TOKENS:
        pairs = adjacent(g)
        rows += [(g, "p", a + b, True) for a, b in sorted(pairs)]
        if g == "ts":
            before, after = {a for a, b in pairs if b == ";"} | {"^", ";"}, {b for a, b in pairs if a == ";"} | {"$"}
            rows += [(g, "l", a + b, True) for a, b in sorted(pairs | {(a, b) for a in before for b in after})]
    return spark.createDataFrame(rows, "grammar string, kind string, a string, ok boolean")


def reduced(content, rules: list[tuple[str, str]], rounds: int = 40):
    """A content reduced by statement productions, ``rounds`` times all of them; what has become short stays as it is."""
    def step(x, _):
        for pattern, short in rules:
            x = F.regexp_replace(x, pattern, short)
        return x

    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(content) + 1, F.lit(rounds))), content, step)


def bad_contents(rows: DataFrame) -> DataFrame:
    """``(grammar, a)`` of the distinct contents ``rows(grammar, a)`` that the statement productions do not reduce to what may be left."""
    # judged as a value of the group, not as its key: a filter on the key would be moved below and judge every row
    c = rows.groupBy("grammar", "a").agg(F.first("a").alias("text")).withColumn("mode", F.substring_index("text", "|", 1)).withColumn("content", F.substring_index("text", "|", -1))
    lines = F.col("mode") == "lines"
    left = F.when(lines, reduced(F.col("content"), LINE_REDUCTIONS)).otherwise(reduced(F.col("content"), REDUCTIONS))
    c = c.withColumn("left", left)
    ok = F.lit(False)
    for mode, pattern in LEFT.items():
        ok = ok | ((F.col("mode") == mode) & F.col("left").rlike(f"^{pattern}$"))
    return c.where(~ok).select("grammar", "a")


def broken_files(files: DataFrame) -> DataFrame:
    """``(file_id, problem)``: files whose text is not valid in the language of its extension, one row each.

    1. The scan lexes each file and emits its distinct pairs of neighbouring tokens, its distinct statements, the distinct
       contents of its blocks, the brackets that chunks of lines leave open and the indentation of Python lines.
    2. Pairs are anti-joined against those that the grammar's productions allow (``grammar.adjacent``).
    3. Contents of blocks, each distinct one once for all files, are reduced by the statement productions (``else`` behind ``if``, ``catch``
       behind ``try``, a body behind each header, an end to each statement); those that leave something over are joined back.
    4. Windows over a file check the nesting of brackets, where openings and closings alternate and agree at every depth, and
       the indentation.

    Null and empty texts and unknown extensions are no cases; ``errors`` plays no part.  file_id null is left out.
    """
    spark = files.sparkSession
    known = list(GRAMMARS)
    ext = F.lower(F.regexp_extract(F.coalesce("path", "short_path"), r"\.([A-Za-z]+)\s*$", 1))
    texts = files.where(F.col("file_id").isNotNull() & (F.length("source_text") > 0)).select("file_id", ext.alias("ext"), "source_text").where(F.col("ext").isin(known))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for fid, e, text in zip(*(part.column(c).to_pylist() for c in ("file_id", "ext", "source_text"))):
                    grammar = GRAMMARS[e]
                    for kind, a, b, place in rows_of(text, grammar):
                        for col, value in zip(cols, (fid, grammar, kind, a, b, place)):
                            col.append(value)
                types = [pa.string()] * 5 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["file_id", "grammar", "kind", "a", "b", "place"])

    rows = cut_lineage(spread(texts).mapInArrow(scan, "file_id string, grammar string, kind string, a string, b string, place bigint"))
    two = F.transform(F.sequence(F.lit(0), (F.length("a") / 2).cast("int") - 1), lambda i: F.substring(F.col("a"), i * 2 + 1, F.lit(2)))
    pieces = F.when(F.col("kind").isin("p", "l") & (F.length("a") > 0), two).when(F.col("kind").isin("s", "c"), F.split("a", "\n")).when(F.col("kind") == "b", F.split("a", "")).otherwise(F.array("a"))
    split = lambda df: df.select("file_id", "grammar", "kind", "b", "place", F.posexplode(pieces).alias("nth", "a")).where(F.col("a") != "")
    # pairs, statements, errors, brackets and indentation in one pass; a pair that finds no permitted one is wrong
    marked = split(rows.where("kind <> 'c'")).join(F.broadcast(permitted_pairs(spark)), ["grammar", "kind", "a"], "left")
    bad_statement = F.lit(False)
    for grammar, pattern in _BAD_STATEMENTS.items():
        bad_statement = F.when(F.col("grammar") == grammar, F.col("a").rlike(pattern)).otherwise(bad_statement)
    kept = marked.where(F.col("ok").isNull() & ((F.col("kind") != "s") | bad_statement))
    contents = split(rows.where("kind = 'c'")).select("file_id", "grammar", "a")
    blocks = contents.join(bad_contents(contents), ["grammar", "a"], "left_semi").select("file_id", F.lit("block").alias("problem"))
    events = kept.select("file_id", "kind", "a", "b", "place", "nth")
    is_open = F.col("a").isin("(", "[", "{")
    bracket = F.col("kind") == "b"
    delta = F.when(bracket, F.when(is_open, 1).otherwise(-1)).otherwise(0)
    in_order = Window.partitionBy("file_id", "kind").orderBy("place", "nth")
    depth = F.sum(delta).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(is_open, F.col("depth")).otherwise(F.col("depth") + 1)
    walked = events.withColumn("depth", depth).withColumn("level", F.when(bracket, level).otherwise(0))
    # line before in the indentation rows
    walked = walked.withColumn("before_opens", F.lag("b").over(in_order) == "1").withColumn("before_width", F.lag(F.col("a").try_cast("int")).over(in_order))
    at_level = Window.partitionBy("file_id", "kind", "level").orderBy("place", "nth")
    closes = F.when(F.col("a") == "(", ")").when(F.col("a") == "[", "]").otherwise("}")
    nested = walked.withColumn("previous", F.lag("a").over(at_level)).withColumn("following", F.lead("a").over(at_level))
    width = F.col("a").try_cast("int")
    wrong = (
        F.when(F.col("kind").isin("p", "l"), F.lit("token pair")).when(F.col("kind") == "s", F.lit("statement")).when(F.col("kind") == "e", F.lit("no token"))
        .when(bracket & is_open & (F.col("following").isNull() | (F.col("following") != closes)), F.lit("bracket"))
        .when(bracket & ~is_open & (F.col("previous").isNull() | ~F.col("previous").isin("(", "[", "{")), F.lit("bracket"))
        .when((F.col("kind") == "i") & F.col("before_opens") & (width <= F.col("before_width")), F.lit("indentation"))
        .when((F.col("kind") == "i") & ~F.coalesce(F.col("before_opens"), F.lit(False)) & (width > F.coalesce(F.col("before_width"), F.lit(0))), F.lit("indentation"))
    )
    found = nested.select("file_id", wrong.alias("problem")).where(F.col("problem").isNotNull()).unionByName(blocks)
    return found.groupBy("file_id").agg(F.min("problem").alias("problem"))
