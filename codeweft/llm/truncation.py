"""Text cut off by field limits: hashed logistic regression trained on artificial cuts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import lookup_join
from codeweft.session import cut_lineage, spread

#: Feature space, and the most rows and bytes that the training sample may have; a text of more than 1 / 64 of the
#: bytes is not drawn.
BITS = 14
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 64 << 20
#: Log odds from which a text counts as cut; the training set holds about two cuts for each intact text.
THRESHOLD = -1.0

#: Marks that exporters put where they cut (fixed values).
MARKS = (
    "…", "...", " ...", "\ufffd", "[…]", "[...]", "(…)", "[truncated]", "(truncated)", "<truncated>", "[message trimmed]", "[message truncated]", "[cut]", "[snip]", "[clipped]",
    "[more]", "(more)", "(continued)", "[continued]", "[read more]", "read more", "Read more...", "[text trimmed]", "[trimmed]", "[+more]", "--More--", "<...>",
)
_MARK_END = re.compile("(?:" + "|".join(re.escape(m) for m in sorted(MARKS, key=len, reverse=True)) + r")\s*$|\[\s*(?:\w+ )?(?:cut|trimmed|truncated|clipped|shortened|abridged)[^\]]{0,20}\]\s*$|\[\+?\d+ (?:chars|characters|bytes|more)[^\]]*\]\s*$", re.I)
_URL_END = re.compile(r"(?:https?:/?/?|www\.)[^\s)\]>]*$")
_WORD = re.compile(r"\w+")
_ENTITY_END = re.compile(r"&[#\w]{0,7}$")
_TAG_END = re.compile(r"<[/\w]{0,7}$")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:return|if|for|while|let|var|const|int|def|else|\}|//|#)|:=|^\s*\$|\w\(|= ")
_RETURN = re.compile(r"^\s*return\b[^;\n]*;?\s*$")
_OPEN = {"(": ")", "[": "]", "{": "}"}


def _char_class(c: str) -> str:
    if c.isalpha():
        return "A" if ord(c) < 0x2E80 else "H"
    if c.isdigit():
        return "9"
    if c.isspace():
        return "_"
    return c if ord(c) < 0x2000 else ("~" if not c.isprintable() else "*")


def _code_state(text: str) -> list[str]:
    """Whether the text ends inside code, and how: fences, tags, indented block, open blocks."""
    out = []
    fences = len(re.findall(r"(?m)^\s*```|```", text))
    fenced = fences % 2 == 1
    if fenced:
        out.append("open-fence")
    low = text.lower()
    tag = low.count("<pre") > low.count("</pre") or low.count("<code") > low.count("</code")
    if tag:
        out.append("open-tag")
    if fences and not fenced and text.rstrip().endswith("```"):
        out.append("fence-closed-last")
    if re.search(r"</(?:pre|code)>\s*$", low):
        out.append("tag-closed-last")
    lines = text.split("\n")
    last = lines[-1]
    block: list[str] = []
    for line in reversed(lines):
        if line.strip() == "":
            if block:
                break
            continue
        if not re.match(r"(?: {4}|\t)", line):
            break
        block.append(line)
    indented = bool(block) and not fenced and not tag and last.strip() != ""
    if block and last.strip() == "" and not fenced and not tag:
        out.append("indented-then-blank")
    if indented:
        out.append("indented-code")
    if indented or fenced or tag:
        where = block[::-1] if indented else text.rsplit("```" if fenced else ">", 1)[-1].split("\n")
        body = [x for x in where if x.strip()]
        widths = [len(x) - len(x.lstrip()) for x in body]
        kind = "ind" if indented else "fen"
        if body:
            same = widths[-1] <= min(widths[1:] or widths)
            done = bool(_RETURN.match(body[-1])) and same
            opened = sum(x.count("{") - x.count("}") for x in body)
            semi = sum(x.rstrip().endswith(";") for x in body) > len(body) / 3
            whole = re.search(r"\w+;$" if semi else r"(?:return|[\w$]+)$", body[-1].rstrip()) is not None
            word = body[-1].split()[-1].rstrip(";")
            known = any(re.search(r"(?<![\w$])" + re.escape(word) + r"(?![\w$])", x) for x in body[:-1]) or re.search(r"\d", word) is None
            out += [f"{kind}-done={done}", f"{kind}-done={done}-whole={whole}-known={known}-bal={opened == 0}", f"{kind}-open={min(opened, 2)}"]
    return out


def features(text: str, gap: int | None, vocabulary: frozenset[str]) -> list[str]:
    """Features of the closing characters, punctuation, code state and distance to the limit (``gap``)."""
    body = text.rstrip()
    marked = _MARK_END.search(body[-40:])
    mark = marked.group(0).strip() if marked else ""
    if marked:  # judge what stands before the mark, as the mark says nothing on "and so on..."
        body = body[: len(body) - len(marked.group(0))].rstrip() or body
        text = body
    last_line = body.rsplit("\n", 1)[-1]
    pieces = body.rsplit(None, 1)
    tail = pieces[-1] if pieces else ""  # up to the last blank
    words = _WORD.findall(last_line)
    classes = "".join(_char_class(c) for c in body[-3:])
    out = ["c3=" + classes, "c2=" + classes[-2:], "c1=" + classes[-1:], "tail4=" + body[-4:].lower(), "tail8=" + body[-8:].lower()]
    ends_alpha = bool(tail) and (tail[-1].isalnum() or tail[-1] in "_$")
    if words:
        w = words[-1].lower()
        known = w in vocabulary
        out += ["w1=" + w, f"known={known}-alpha={ends_alpha}", f"wlen={min(len(w), 6)}-known={known}-alpha={ends_alpha}"]
        if len(words) > 1:
            out.append("w2=" + words[-2].lower() + " " + w + classes[-1:])
        if len(words) > 2:
            out.append("w3=" + " ".join(words[-3:]).lower())
    stripped = len(text) - len(body)
    out.append(f"trailing={min(stripped, 2)}-{'n' if stripped and text[len(body)] == chr(10) else 's'}-alpha={ends_alpha}")
    if mark:
        known_end = bool(words) and words[-1].lower() in vocabulary
        out += ["mark", "mark-word" if re.search("[a-z]{3}", mark.lower()) else f"mark-sign-known={known_end}", "mark=" + mark.lower(), "mark-replacement=" + str(mark == chr(0xFFFD))]
    url = _URL_END.search(tail)
    if url:
        u = url.group(0)
        done = re.match(r"https?://[^/\s]+\.\w+/[\w./-]*\w$", u) is not None
        out.append(f"url-done={done}-segments={min(u.count('/'), 5)}-digit={u[-1].isdigit()}")
    if _ENTITY_END.search(tail) and not tail.endswith(";"):
        out.append("partial-entity")
    if _TAG_END.search(tail):
        out.append("partial-tag")
    stack = []
    for c in last_line:
        if c in _OPEN:
            stack.append(c)
        elif stack and c == _OPEN[stack[-1]]:
            stack.pop()
    out.append(f"unclosed={''.join(stack[-2:])}")
    out.append(f"odd-tick={last_line.count('`') % 2}-quote={last_line.count(chr(34)) % 2}")
    code = _code_state(text)
    out += code
    incode = any(x.startswith(("open", "indented-code")) for x in code)
    sentence = bool(tail) and tail[-1] in ".!?。！？:)" and not tail.endswith("..") and not incode
    out += [f"incode={incode}-c1={classes[-1:]}", f"sentence={sentence}", f"lines={min(text.count(chr(10)), 3)}-alpha={ends_alpha}-incode={incode}"]
    size = "tiny" if len(body) < 30 else "short" if len(body) < 60 else "long"
    out.append(f"size={size}-alpha={ends_alpha}-sentence={sentence}")
    # the last clause alone on its line or after two blanks is how signatures stand
    segment = re.split(r"\n|  +", body)[-1]
    out.append(f"segment={min(len(segment) // 12, 6)}-alpha={ends_alpha}-incode={incode}")
    out.append("seg=" + re.sub(r"\d+", "0", segment.lower())[:40] if len(segment) < 40 else "seg-long")
    seg_words = segment.split()
    out.append("seg2=" + " ".join(seg_words[:2]).lower() + f"-{min(len(seg_words), 8)}")
    if gap is not None:
        out.append("gap=" + ("0" if gap <= 0 else "1-2" if gap <= 2 else "near" if gap <= 12 else "far"))
        if gap <= 2:
            out.append(f"at-limit-sentence={sentence}")
    return out


def _indices(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in dict.fromkeys(names)], dtype=np.int32)


def artificial_cut(text: str, rng: random.Random) -> str | None:
    """``text`` stopped inside a word, sentence, link or piece of code; None where it is too short."""
    if len(text) < 30:
        return None
    for _ in range(8):
        at = rng.randint(max(12, len(text) // 10), len(text) - 2)
        left, right = text[:at], text[at:]
        if left.strip() and left.rstrip()[-1] not in ".!?。)" and right.strip() and not left.endswith("\n") and not right.startswith("\n"):
            if not left.rstrip().endswith(("```", "</pre>", "</code>")):
                return left
    return None


class TruncationModel:
    """Weights over hashed features; ``fit`` on a bounded sample, ``score`` any text."""

    def __init__(self, weights: np.ndarray, bias: float, vocabulary: frozenset[str]):
        self.weights, self.bias, self.vocabulary = weights, bias, vocabulary

    @classmethod
    def fit(cls, texts: list[str], gaps: list[int | None], seed: int = 17, epochs: int = 4) -> TruncationModel:
        """Intact values are those not at their source's limit; cuts of them are the positives.

        Some presumed intact values were cut in transfer.  A first fit finds those that look cut
        beyond doubt, and the second fit leaves them out.
        """
        rng = random.Random(seed)
        counts = Counter(w.lower() for t in texts for w in set(_WORD.findall(t)))
        vocabulary = frozenset(w for w, n in counts.most_common(20_000) if n >= 3)
        intact = [t for t, g in zip(texts, gaps) if g is None or g > 2]
        cuts = []
        for t in intact:
            for _ in range(2 if len(t) > 200 else 1):
                cut = artificial_cut(t, rng)
                if cut is not None:
                    at = 0 if rng.random() < 0.4 else None
                    cuts.append((cut + (rng.choice(("", " ")) + rng.choice(MARKS) if rng.random() < 0.1 else ""), at))
        rows = [_indices(features(t, None, vocabulary)) for t in intact]
        bad = [_indices(features(t, g, vocabulary)) for t, g in cuts]
        weights, bias = cls._train(rows, bad, seed, epochs)
        keep = [r for r in rows if weights[r].sum() + bias < -1.0]
        weights, bias = cls._train(keep, bad, seed, epochs)
        return cls(weights, bias, vocabulary)

    @staticmethod
    def _train(negative: list[np.ndarray], positive: list[np.ndarray], seed: int, epochs: int, batch: int = 16) -> tuple[np.ndarray, float]:
        """Adagrad over the logistic loss in small batches of rows, with light L2."""
        rows = negative + positive
        y = np.array([0.0] * len(negative) + [1.0] * len(positive))
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if rows else sizes
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1.0)
        bias, b2 = 0.0, 1.0
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            mixed = order.permutation(len(rows))
            for at in range(0, len(mixed), batch):
                part = mixed[at : at + batch]
                n = sizes[part]
                owner = np.repeat(np.arange(len(part)), n)
                used = flat[np.repeat(starts[part] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
                z = np.bincount(owner, weights=w[used], minlength=len(part)) + bias
                d = 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))) - y[part]
                cells, where = np.unique(used, return_inverse=True)
                grad = np.bincount(where, weights=d[owner]) + 1e-5 * w[cells]
                g2[cells] += np.bincount(where, weights=d[owner] ** 2)
                w[cells] -= 0.3 * grad / np.sqrt(g2[cells])
                b2 += float((d * d).sum())
                bias -= 0.3 * float(d.sum()) / np.sqrt(b2)
        return w, bias

    def score(self, text: str, gap: int | None) -> float:
        """Log odds that ``text`` was cut."""
        return float(self.weights[_indices(features(text, gap, self.vocabulary))].sum() + self.bias)


def text_sizes(docs: DataFrame) -> DataFrame:
    """``(source, unit, size, n)``: how many texts of a source have a length, in characters (char) and in bytes (byte)."""
    units = F.array(F.struct(F.lit("char").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("byte").alias("unit"), F.octet_length("text").alias("size")))
    sized = docs.where(F.col("text").isNotNull()).select(F.coalesce("source", F.lit("")).alias("source"), F.explode(units).alias("u")).select("source", "u.*")
    return sized.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))


def source_limits(sizes: DataFrame, min_pile: int = 4, share: float = 0.005) -> DataFrame:
    """``(source, char_limit, byte_limit, n_texts)`` of every source whose long texts pile up at one length.

    A limit is the most frequent length (in characters, and in bytes) within 2 % of the source's longest text, if at
    least ``min_pile`` texts and ``share`` of the source's have it.  It depends on the source's own texts only.
    """
    whole = sizes.groupBy("source", "unit").agg(F.sum("n").alias("total"), F.max("size").alias("longest"))
    piles = sizes.join(whole.where("longest > 40"), ["source", "unit"]).where(
        (F.col("size") >= 0.98 * F.col("longest")) & (F.col("n") >= min_pile) & (F.col("n") >= share * F.col("total"))
    )
    limit = lambda unit: F.max(F.when(F.col("unit") == unit, F.struct("n", "size"))).getField("size")
    return piles.groupBy("source").agg(limit("char").alias("char_limit"), limit("byte").alias("byte_limit"), F.max("total").alias("n_texts"))


def truncation_scores(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, source, log_odds, truncated)`` of every document.

    The model is fitted on a sample of at most ``sample_rows`` documents and about ``sample_bytes`` bytes drawn by a
    hash of doc_id; limits (of every source, however small) and scores cover all documents and whole texts.  Null,
    empty and blank texts are not truncated and have null odds; a null source counts as a source of its own, ''.
    """
    docs = spread(docs.select("doc_id", "text", "source")).withColumn("source", F.coalesce("source", F.lit("")))
    sizes = cut_lineage(text_sizes(docs))  # one row a source and length
    known = sizes.where("unit = 'byte'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("bytes")).first()
    limits = cut_lineage(source_limits(sizes))
    marked = lookup_join(docs, limits, ["source"], "n_texts", known["rows"], how="left")
    gap = F.least(F.abs(F.col("char_limit") - F.length("text")), F.abs(F.col("byte_limit") - F.octet_length("text")))
    marked = marked.select("doc_id", "source", "text", gap.alias("gap"))
    # a little less than allowed, so that the limit below is a bound and hardly ever cuts
    share = min(1.0, 0.95 * sample_rows / max(known["rows"], 1), 0.95 * sample_bytes / max(known["bytes"], 1))
    drawn = marked.where((F.length(F.trim(F.col("text"))) > 0) & (F.octet_length("text") <= sample_bytes // 64)).where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = drawn.select("doc_id", "text", "gap").limit(sample_rows).collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    if sample:
        model = TruncationModel.fit([r["text"] for r in sample], [r["gap"] for r in sample])
    else:
        model = TruncationModel(np.zeros(1 << BITS), -1.0, frozenset())
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.vocabulary))  # bounded by BITS and 20,000 words

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TruncationModel(*shared.value)
        for b in batches:
            gaps = [None if pd.isna(g) else int(g) for g in b["gap"]]
            odds = [own.score(t, g) if t is not None and t.strip() else None for t, g in zip(b["text"], gaps)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "log_odds": pd.array(odds, dtype="Float64"), "truncated": [o is not None and o > THRESHOLD for o in odds]})

    return marked.mapInPandas(score, "doc_id bigint, source string, log_odds double, truncated boolean")
