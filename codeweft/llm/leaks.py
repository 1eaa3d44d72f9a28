"""Evaluation texts leaking into training text: Wu-Manber seeds over words, then alignment."""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import hot_cold_join
from codeweft.session import cut_lineage, spread

#: A passage has at least so many words, of which one in REPLACED may differ.
PASSAGE = 20
REPLACED = 6
#: Words of a seed and of a block of the shift table.  A passage of 20 words with three replaced and one
#: interruption keeps a run of 4 words.
SEED = 4
BLOCK = 2
#: Wording of so many words that at least so many items hold is shared and no passage of any; wording of fewer items is
#: a passage of each of them.
SHARED, SHARED_BY = 12, 4
#: Of the information in a passage so much must be matched, and so many bits at least.  A word's information is
#: how little the word before it predicts it in the other items: words of a common mould carry next to none, so
#: that a text cast in the same mould as an item, with other names and numbers, holds no passage of it.
INFORMATION, BITS = 0.67, 14.0
#: Bits of each part of an interrupted passage, and of both.
PART_BITS, PAIR_BITS = 4.0, 20.0
#: Bytes of item text that one pass over the documents takes, about.
PASS_BYTES = 64 << 20

#: Letters of other scripts that look like Latin ones (fixed values).
CONFUSABLES = str.maketrans(
    "аеорсухіјѕһԁԛԝгкмнтвьԍɡοαενικρτυχβημωıℓ",
    "aeopcyxijshdqwrkmhtbbggoaevikptuxbnmwil",
)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>", re.S)
_HYPHEN_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, mark-up, punctuation, invisible characters, accents and look-alike letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = _HYPHEN_BREAK.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Me"))
        return _WORD.findall(text.translate(CONFUSABLES))
    return _WORD.findall(text.lower())


def local_statistics(items: list[tuple[int, str]]) -> list[tuple[int, list[str], list[bool], list[float]]]:
    """``(item_id, words, shared, bits)`` of a few items in plain Python, as ``item_statistics`` makes them of a table."""
    known = [(i, words_of(t)) for i, t in items if t and t.strip()]
    holders: dict[tuple[str, ...], set[int]] = defaultdict(set)
    pairs: Counter[tuple[str, str]] = Counter()
    firsts: Counter[str] = Counter()
    for n, (_, ws) in enumerate(known):
        pairs.update(zip(["", *ws], ws))
        firsts.update(["", *ws][: len(ws)])
        for q in range(len(ws) - SHARED + 1):
            holders[tuple(ws[q : q + SHARED])].add(n)
    out = []
    for i, ws in known:
        flags = [False] * len(ws)
        for q in range(len(ws) - SHARED + 1):
            if len(holders[tuple(ws[q : q + SHARED])]) >= SHARED_BY:
                flags[q : q + SHARED] = [True] * SHARED
        mine, heads = Counter(zip(["", *ws], ws)), Counter(["", *ws][: len(ws)])
        out.append((i, ws, flags, [bits_of(pairs[a, w] - mine[a, w], firsts[a] - heads[a]) for a, w in zip(["", *ws], ws)]))
    return out


def bits_of(pair: int, first: int) -> float:
    """Information of a word that follows its predecessor ``pair`` of ``first`` times in the other items."""
    return -math.log2((pair + 0.1) / (first + 1.0)) if first > 0 else 6.0


class LeakIndex:
    """The shift and suffix tables of all seeds of items ``(item_id, words, shared, bits)``."""

    def __init__(self, items: list[tuple[int, list[str], list[bool], list[float]]]):
        self.items = [i for i, *_ in items]
        self.shared = [s for _, _, s, _ in items]
        self.info = [x for *_, x in items]
        self.ids: dict[str, int] = {}
        self.coded = [[self.ids.setdefault(w, len(self.ids)) for w in ws] for _, ws, _, _ in items]
        self.width = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, ws in enumerate(self.coded):
            for q in range(len(ws) - SEED + 1):
                if any(self.shared[n][q : q + SEED]):
                    continue
                seed = ws[q : q + SEED]
                for end in range(BLOCK, SEED + 1):
                    block = seed[end - 2] * self.width + seed[end - 1]
                    self.shift[block] = min(self.shift.get(block, SEED), SEED - end)
                self.buckets[seed[-2] * self.width + seed[-1]][tuple(seed[:-BLOCK])].append((n, q))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def seeds(self, coded: list[int]) -> dict[int, list[tuple[int, int]]]:
        """Item -> places ``(in the text, in the item)`` at which a seed matches."""
        hits: dict[int, list[tuple[int, int]]] = {}
        shift, width, buckets = self.shift, self.width, self.buckets
        i, n, skip = SEED - 1, len(coded), SEED - BLOCK + 1
        while i < n:
            b = coded[i]
            if b < 0:  # a word of no item: no seed covers it
                i += SEED
                continue
            a = coded[i - 1]
            if a < 0:
                i += SEED - 1
                continue
            block = a * width + b
            step = shift.get(block, skip)
            if step:
                i += step
                continue
            start = i - SEED + 1
            for item, q in buckets[block].get(tuple(coded[start : i - 1]), ()):
                hits.setdefault(item, []).append((start, q))
            i += 1
        return hits

    def _coded(self, text: str) -> list[int]:
        get = self.ids.get
        return [get(w, -1) for w in words_of(text)]

    def _passage(self, coded: list[int], item: int, places: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
        length, _, spans = best_passage(coded, self.coded[item], self.shared[item], self.info[item], {p - q for p, q in places})
        return length, spans

    def candidates(self, text: str) -> list[int]:
        """Ids of the items of which ``text`` holds a passage, each judged as if it were the only item."""
        coded = self._coded(text)
        return [self.items[i] for i, ps in self.seeds(coded).items() if len(ps) >= 2 and self._passage(coded, i, ps)[0] >= PASSAGE]

    def passages(self, text: str) -> list[tuple[int, int]]:
        """``(item_id, words)`` of the items of which ``text`` holds a passage, with the length found.

        A place in a text is a passage of the items that match it best: the item with most seeds comes first, with it
        every other item that has all of its seeds, and the words they explain count for no item that matches less.
        Two items of one mould would else both be found in a passage of one of them.
        """
        coded = self._coded(text)
        hits = self.seeds(coded)
        out = []
        while hits:
            first = max(hits, key=lambda i: (len(hits[i]), -self.items[i]))
            if len(hits[first]) < 2:  # 17 equal words in at most 5 runs hold two seeds at least
                break
            reached = {p for p, _ in hits[first]}
            equal = [i for i, ps in hits.items() if i == first or len(ps) >= len(reached) and reached <= {p for p, _ in ps}]
            found = [(i, places, *self._passage(coded, i, places)) for i, places in ((i, hits.pop(i)) for i in equal)]
            found = [f for f in found if f[2] >= PASSAGE]
            for item, places, length, spans in found:
                out.append((self.items[item], length))
                self._explain(coded, item, places, spans)
            if found:
                hits = {i: [x for x in ps if coded[x[0]] >= 0 and coded[x[0] + SEED - 1] >= 0] for i, ps in hits.items()}
        return out

    def _explain(self, coded: list[int], item: int, places: list[tuple[int, int]], spans: list[tuple[int, int]]) -> None:
        """Blank the words of a found item: its passage, and its other parts, such as after a second interruption."""
        parts = [(a + d, b + d) for d in {p - q for p, q in places} for a, b, _, bits, _, _ in _whole_windows(coded, self.coded[item], self.shared[item], self.info[item], d) if bits >= PART_BITS * 2]
        for a, b in [*spans, *parts]:
            coded[a:b] = [-1] * (b - a)


def _windows(text: list[int], item: list[int], shared: list[bool], info: list[float], diagonal: int) -> list[tuple[int, int, int, float, float, int]]:
    """Windows ``(from, to, replaced, bits matched, bits in all, end of the first run)`` in item places, between runs of
    equal words.  A window is kept whatever its own share of replaced words; no passage of the item allows more in number."""
    lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
    runs: list[tuple[int, int, float]] = []
    q = lo
    while q < hi:
        if not shared[q] and text[q + diagonal] == item[q]:
            start, bits = q, 0.0
            while q < hi and not shared[q] and text[q + diagonal] == item[q]:
                bits += info[q]
                q += 1
            runs.append((start, q, bits))
        else:
            q += 1
    out = []
    for i in range(len(runs)):
        bad, bits, lost = 0, 0.0, 0.0
        for j in range(i, len(runs)):
            if j > i:
                gap = range(runs[j - 1][1], runs[j][0])
                bad += len(gap)
                if bad * REPLACED > len(item) or any(shared[g] for g in gap):
                    break
                lost += sum(info[g] for g in gap)
            bits += runs[j][2]
            if runs[j][1] - runs[i][0] >= 3:
                out.append((runs[i][0], runs[j][1], bad, bits, bits + lost, runs[i][1]))
    return out


def _whole_windows(text: list[int], item: list[int], shared: list[bool], info: list[float], diagonal: int) -> list[tuple[int, int, int, float, float, int]]:
    """Windows that keep the limit of replaced words by themselves."""
    return [w for w in _windows(text, item, shared, info, diagonal) if w[2] * REPLACED <= w[1] - w[0]]


def _unseeded(text: list[int], item: list[int], shared: list[bool], info: list[float], seeded: set[int]) -> tuple[set[int], float]:
    """Diagonals without a seed whose equal words carry enough information for a part, and the bits such a part needs:
    it is the best of as many places as there are diagonals."""
    need = PART_BITS + math.log2(len(text) + len(item))
    places: dict[int, list[int]] = defaultdict(list)
    for q, w in enumerate(item):
        if not shared[q]:
            places[w].append(q)
    bits: dict[int, float] = defaultdict(float)
    for p, w in enumerate(text):
        for q in places.get(w, ()):
            bits[p - q] += info[q]
    return {d for d, x in bits.items() if x >= need and d not in seeded}, need


def best_passage(text: list[int], item: list[int], shared: list[bool], info: list[float], diagonals: set[int]) -> tuple[int, float, list[tuple[int, int]]]:
    """``(words, bits, places in the text)`` of the longest passage of ``item``: one window, or two in order
    with one interruption between, each of which carries information of its own.

    One part at least lies on a seeded diagonal; the other is searched on all.  Replaced words are judged
    over both parts and the words lost at the break.
    """
    windows = [(*w, d) for d in diagonals for w in _windows(text, item, shared, info, d)]
    best: tuple[int, float, list[tuple[int, int]]] = (0, 0.0, [])
    for a, b, bad, bits, whole, _, d in windows:
        if bad * REPLACED <= b - a and bits >= BITS and bits >= INFORMATION * whole:
            best = max(best, (b - a, bits, [(a + d, b + d)]))
    further, need = _unseeded(text, item, shared, info, diagonals)
    parts = [(w, PART_BITS) for w in windows if w[3] >= PART_BITS and w[1] - w[0] >= SEED]
    parts += [((*w, d), need) for d in further for w in _windows(text, item, shared, info, d) if w[3] >= need and w[1] - w[0] >= SEED]
    for (a1, b1, bad1, bits1, all1, _, d1), need1 in parts:
        for (a2, b2, bad2, bits2, all2, run2, d2), need2 in parts:
            # the second part goes on in the item about where the first stopped, and later in the text
            if d2 <= d1 or a2 < a1 or b2 - a1 <= best[0] or (need1 > PART_BITS and need2 > PART_BITS):
                continue
            if a2 < b1:  # words behind the break equal by chance count once
                if run2 <= b1 or b2 - b1 < SEED:
                    continue
                twice = sum(info[a2:b1])
                a2, bits2, all2 = b1, bits2 - twice, all2 - twice
                if bits2 < need2:
                    continue
            lost = range(b1, a2)
            length, bits = b2 - a1, bits1 + bits2
            if (bad1 + bad2 + len(lost)) * REPLACED <= length and not any(shared[g] for g in lost) and bits >= PAIR_BITS and bits >= INFORMATION * (all1 + all2 + sum(info[g] for g in lost)):
                best = (length, bits, [(a1 + d1, b1 + d1), (a2 + d2, b2 + d2)])
    return best


def item_statistics(items: DataFrame) -> DataFrame:
    """``(item_id, words, shared, bits, n_bytes)`` of every item with words, by counts over all items.

    ``shared`` marks words in runs of SHARED words that at least SHARED_BY items hold; ``bits`` is a word's information
    given the word before it, by the counts of all other items.  Null ids and null or blank texts are left out.
    """
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "words": [words_of(t) for t in b["text"]]})

    known = items.where(F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("item_id", "text").distinct()
    worded = cut_lineage(known.mapInPandas(split, "item_id bigint, words array<string>").where(F.size("words") > 0).withColumn("key", F.monotonically_increasing_id()))
    tokens = worded.select("key", F.posexplode("words").alias("at", "word"), "words").select("key", "at", "word", F.when(F.col("at") > 0, F.element_at("words", F.col("at"))).otherwise("").alias("prev"))
    # a word and its predecessor in one item, then over all items
    mine = cut_lineage(tokens.groupBy("key", "prev", "word").agg(F.count(F.lit(1)).alias("m")))
    pairs = mine.groupBy("prev", "word").agg(F.sum("m").alias("p"), F.count(F.lit(1)).alias("n_uses"))
    heads = mine.groupBy("key", "prev").agg(F.sum("m").alias("h"))
    firsts = heads.groupBy("prev").agg(F.sum("h").alias("f"), F.count(F.lit(1)).alias("n_uses"))
    rows = mine.count()
    by_pair = hot_cold_join(mine, pairs, ["prev", "word"], "n_uses", rows).drop("n_uses")
    by_head = hot_cold_join(heads, firsts, ["prev"], "n_uses", rows).drop("n_uses")
    known_bits = by_pair.join(by_head, ["key", "prev"])
    rest = F.col("f") - F.col("h")
    bits = F.when(rest > 0, -F.log2((F.col("p") - F.col("m") + 0.1) / (rest + 1.0))).otherwise(6.0)
    table = known_bits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "prev", "word"), bits))).alias("table"))
    # places at which a shared run starts; a run is compared by 128 bits of hash
    starts = worded.where(F.size("words") >= SHARED).select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - SHARED + 1), lambda i: F.slice("words", i, F.lit(SHARED)))).alias("at", "run"))
    starts = starts.select("key", "at", F.xxhash64("run").alias("x"), F.xxhash64(F.lit(1), "run").alias("y"))
    held = starts.select("key", "x", "y").distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") >= SHARED_BY)
    runs = hot_cold_join(starts, held, ["x", "y"], "n_items", rows).groupBy("key").agg(F.collect_set("at").alias("runs"))
    joined = worded.join(table, "key").join(runs, "key", "left")
    before = lambda i: F.when(i > 0, F.element_at("words", i)).otherwise("")
    flags = F.transform("words", lambda w, i: F.coalesce(F.exists("runs", lambda r: (r <= i) & (i < r + SHARED)), F.lit(False)))
    return joined.select(
        "item_id", "words", flags.alias("shared"), F.transform("words", lambda w, i: F.element_at("table", F.concat_ws(" ", before(i), w))).alias("bits"),
        F.octet_length(F.array_join("words", " ")).alias("n_bytes"),
    )


#: The index of the pass a process works on, by the pass's token.
_INDEX: dict[str, LeakIndex] = {}


def _index_of(token: str, shared) -> LeakIndex:
    """The index of the items in a broadcast, built once in each process."""
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = LeakIndex(shared.value)
    return _INDEX[token]


def find_leaks(docs: DataFrame, items: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_words)``: every document that holds a passage of an item, once per item.

    The items are the query set.  Shared wording and the information of words are counted over all of them; then
    they are searched in passes of about ``pass_bytes``, each of which streams over all documents without a shuffle.
    Where there is one pass, the items of a document are judged against each other at once; of several
    passes, the documents with candidates are judged once more with the candidates of all passes, so the rows
    don't depend on the number of passes.  Null and empty texts hold nothing; repeated documents with one
    doc_id give one row.
    """
    spark = docs.sparkSession
    known = cut_lineage(item_statistics(items))
    size = known.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    passes = max(1, -(-size // pass_bytes))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    texts = spread(texts)
    schema = "doc_id bigint, item_id bigint, n_words bigint"
    found = None
    for k in range(passes):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        rows = [(r["item_id"], r["words"], r["shared"], r["bits"]) for r in part.orderBy("item_id").collect()]
        shared = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pd.DataFrame], token=uuid.uuid4().hex, shared=shared, whole=passes == 1) -> Iterator[pd.DataFrame]:
            index = _index_of(token, shared)
            for b in batches:
                if whole:
                    hits = [(d, i, n) for d, t in zip(b["doc_id"], b["text"]) if t for i, n in index.passages(t)]
                else:
                    hits = [(d, i, 0) for d, t in zip(b["doc_id"], b["text"]) if t for i in index.candidates(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "n_words"]).astype("int64")

        hits = texts.mapInPandas(search, schema)
        found = hits if found is None else found.unionByName(hits)
    if passes > 1:
        asked = cut_lineage(found.select("doc_id", "item_id").distinct())
        uses = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        item = known.join(uses, "item_id").select("item_id", "n", F.struct("item_id", "words", "shared", "bits").alias("item"))
        # the items of one document: as many as it holds passages of, or nearly
        full = hot_cold_join(asked, item, ["item_id"], "n", asked.count()).groupBy("doc_id").agg(F.collect_list("item").alias("items"))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                hits = []
                for d, t, own in zip(b["doc_id"], b["text"], b["items"]):
                    rows = sorted((int(x["item_id"]), list(x["words"]), list(x["shared"]), list(x["bits"])) for x in own)
                    hits += [(d, i, n) for i, n in LeakIndex(rows).passages(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "n_words"]).astype("int64")

        found = texts.join(full, "doc_id").mapInPandas(judge, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
