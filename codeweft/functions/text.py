"""Text functions: tokens, n-grams, hashing, identifiers, slugs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case tokens of at least two characters of [a-z0-9_], in order; ``stop_words`` is a parameter."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    if not stop_words:
        return found
    banned = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(found, lambda t: ~F.array_contains(banned, t))


def ngrams(toks, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by a blank, shorter runs first."""
    t = _c(toks)

    def run(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    runs = [run(n) for n in range(low, high + 1)]
    return F.concat(*runs)


def identifier_words(name) -> Column:
    """Words of a camelCase, snake_case or numbered identifier, lower-case."""
    spaced = F.regexp_replace(_c(name), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), "[^a-z0-9]+", "-"), "^-|-$", "")


def initials(name) -> Column:
    """First letters of up to three words, upper-case; else the first character; '?' without a name."""
    n = _c(name)
    words = F.filter(F.split(F.trim(n), r"\s+"), lambda w: w != "")
    letters = F.filter(F.transform(words, lambda w: F.upper(F.regexp_extract(w, r"(\p{L})", 1))), lambda x: x != "")
    shown = F.substring(F.array_join(letters, ""), 1, 3)
    return F.when(n.isNull() | (n == ""), "?").when(shown != "", shown).otherwise(F.upper(F.substring(F.trim(n), 1, 1)))


def avatar(email, size: int = 80) -> Column:
    """Address of the picture of an e-mail address; '' without one."""
    e = F.lower(F.trim(_c(email)))
    url = F.concat(F.lit("https://www.gravatar.com/avatar/"), F.md5(e), F.lit(f"?s={size}&d=404"))
    return F.when(e.contains("@"), url).otherwise("")


#: Colours of contributors, that of a missing name last (fixed values).
COLOURS = "#3b82f6 #8b5cf6 #ec4899 #06b6d4 #6366f1 #14b8a6 #a855f7 #0ea5e9 #d946ef #64748b #7c3aed #0891b2".split()
NO_COLOUR = "#9ca3af"


def fnv32a(data: bytes) -> int:
    """FNV-1a of 32 bits (public algorithm)."""
    h = 0x811C9DC5
    for x in data:
        h = ((h ^ x) * 0x01000193) & 0xFFFFFFFF
    return h


@F.pandas_udf(T.StringType())
def contributor_colour(name: pd.Series) -> pd.Series:
    """One of COLOURS by the FNV-1a hash of a name; NO_COLOUR for null and ''."""
    return name.map(lambda n: COLOURS[fnv32a(n.encode()) % len(COLOURS)] if n else NO_COLOUR)


def cache_key(changed, size) -> Column:
    """Key under which a file's result is cached: time of the last change in nanoseconds, and size."""
    return F.concat((F.unix_micros(_c(changed).cast("timestamp")) * 1000).cast("string"), F.lit("_"), _c(size).cast("string"))


def one_hot(value, categories: Sequence[str], weight: float = 1.0) -> tuple[Column, dict[str, Column]]:
    """The code of a category (-1 where it is none) and a column of ``weight`` or 0 for each."""
    v = _c(value)
    code = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in categories]), v) - 1, F.lit(-1)).cast("bigint")
    return code, {f"is_{x.lower().replace('#', 'sharp')}": F.when(v == x, float(weight)).otherwise(0.0) for x in categories}


def read_stop_words(path: str) -> list[str]:
    """Stop words of a text file, blank or line separated, for ``tokens``."""
    with open(path, encoding="utf-8") as f:
        return sorted(set(f.read().split()))


def lint_message_key(message, root: str = "") -> Column:
    """A lint message without root and numbers, so that a drifted number is no new finding."""
    m = _c(message)
    m = F.replace(m, F.lit(root), F.lit("")) if root else m
    return F.regexp_replace(m, "[0-9]+", "#")


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Murmur3 x86 32-bit of a byte string (public algorithm)."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    h = seed
    whole = len(data) // 4 * 4
    for (k,) in zip(np.frombuffer(data[:whole], dtype="<u4").tolist()):
        k = (k * c1) & mask
        k = ((k << 15) | (k >> 17)) & mask
        h ^= (k * c2) & mask
        h = ((h << 13) | (h >> 19)) & mask
        h = (h * 5 + 0xE6546B64) & mask
    k = int.from_bytes(data[whole:], "little")
    if data[whole:]:
        k = (k * c1) & mask
        k = ((k << 15) | (k >> 17)) & mask
        h ^= (k * c2) & mask
    h ^= len(data)
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & mask
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & mask
    return h ^ (h >> 16)


@F.pandas_udf(T.LongType())
def murmur3(text: pd.Series) -> pd.Series:
    """Unsigned murmur3 with seed 0 of UTF-8 text; null for null."""
    seen: dict[str, int] = {}
    out = []
    for t in text:
        if t is None:
            out.append(None)
            continue
        if t not in seen:
            seen[t] = murmur3_32(t.encode())
        out.append(seen[t])
    return pd.Series(out, dtype="Int64")


def hash_bin(hashed, bins: int) -> Column:
    """Bin of an unsigned 32-bit hash: |as signed| mod bins."""
    h = _c(hashed)
    signed = F.when(h >= 2**31, h - F.lit(2**32)).otherwise(h)
    return F.abs(signed) % bins


def cosine(a, b) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    a, b = _c(a), _c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)
