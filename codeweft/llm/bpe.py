"""Whole-corpus encoding with a public byte-level BPE vocabulary, in padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codeweft.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How byte-level BPE cuts text into pieces before merging (fixed value of the vocabulary).
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Pieces beyond so many bytes are merged by a heap: a matrix row would need a round for each merge.
LONGEST_ROW = 256
#: Cells of one matrix at most.
CELLS = 1 << 21


class BytePairEncoder:
    """Merges of one vocabulary as an open-addressing hash table of (left id, right id) -> merged id."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left, right)] = rank
        self.pairs = pairs
        size = 1 << (len(pairs) * 3).bit_length()
        self.mask = size - 1
        keys = np.full(size, -1, dtype=np.int64)
        values = np.full(size, np.iinfo(np.int64).max, dtype=np.int64)
        todo = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        ids = np.array(list(pairs.values()), dtype=np.int64)
        slot = self._slot(todo)
        self.probes = 0
        while len(todo):  # all at once: the first of each free slot settles, the others move on
            self.probes += 1
            free = np.flatnonzero(keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            keys[slot[won]], values[slot[won]] = todo[won], ids[won]
            rest = np.ones(len(todo), dtype=bool)
            rest[won] = False
            todo, ids, slot = todo[rest], ids[rest], (slot[rest] + 1) & self.mask
        self.keys, self.values = keys, values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(20)).astype(np.int64) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, which is its rank too; the largest integer where there is none."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        out = np.full(keys.shape, np.iinfo(np.int64).max, dtype=np.int64)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat_keys, flat_slot, flat_out = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            found = self.keys[flat_slot[open_]]
            hit = found == flat_keys[open_]
            flat_out[open_[hit]] = self.values[flat_slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            flat_slot[open_] = (flat_slot[open_] + 1) & self.mask
        return flat_out.reshape(keys.shape)

    def _merge_matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Rows of padded ids: in each round every row merges its leftmost pair of minimum rank and closes the gap."""
        width = max(map(len, pieces))
        m = np.full((len(pieces), width), -1, dtype=np.int64)
        lengths = np.array([len(p) for p in pieces])
        m[np.arange(width)[None, :] < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pair = self.merged(m[:, :-1], m[:, 1:])
        live = np.arange(len(pieces))
        none = np.iinfo(np.int64).max
        done = m
        while width > 1:
            at = pair.argmin(axis=1)
            best = pair[np.arange(len(at)), at]
            go = best != none
            if not go.all():  # compaction: finished rows leave the matrix
                done[live[~go], : m.shape[1]] = m[~go]
                done[live[~go], m.shape[1]:] = -1
                live, m, pair, at, best = live[go], m[go], pair[go], at[go], best[go]
                if not len(live):
                    break
            rows, cols = np.arange(len(at)), np.arange(m.shape[1])[None, :]
            shift = np.minimum(cols + (cols > at[:, None]), m.shape[1] - 1)
            m = np.take_along_axis(m, shift, axis=1)
            m[:, -1] = -1
            m[rows, at] = best
            cols = cols[:, :-1]
            shift = np.minimum(cols + (cols > at[:, None]), pair.shape[1] - 1)
            pair = np.take_along_axis(pair, shift, axis=1)
            pair[:, -1] = none
            left = np.maximum(at - 1, 0)
            pair[rows, left] = np.where(at > 0, self.merged(m[rows, left], m[rows, at]), pair[rows, left])
            right = np.minimum(at + 1, m.shape[1] - 1)
            inside = at < pair.shape[1]
            new = self.merged(m[rows, at], np.where(at + 1 < m.shape[1], m[rows, right], -1))
            pair[rows[inside], at[inside]] = new[inside]
        else:
            done[live, : m.shape[1]] = m
        sizes = (done >= 0).sum(axis=1)
        return [row[:n].tolist() for row, n in zip(done, sizes)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges over a linked list with a heap of (rank, position)."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := self.pairs.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pieces; buckets of like length share a padded matrix."""
        out: dict[bytes, list[int]] = {}
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = [whole]
            elif len(p) > LONGEST_ROW:
                out[p] = self._merge_long(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bucket in buckets.values():
            step = max(1, CELLS // max(map(len, bucket)))
            for i in range(0, len(bucket), step):
                part = bucket[i : i + step]
                out.update(zip(part, self._merge_matrix(part)))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text; [] for an empty one, None for null."""
        cut = [None if t is None else [x.encode("utf-8", "surrogatepass") for x in PIECES.findall(t)] for t in texts]
        ids = self.encode_pieces(list({p for pieces in cut if pieces for p in pieces}))
        return [None if pieces is None else [i for p in pieces for i in ids[p]] for pieces in cut]


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> BytePairEncoder:
    """The encoder of a vocabulary file, built once per process."""
    return BytePairEncoder(path)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``, one row per row of ``docs``: whole texts, no special tokens.

    The names of special tokens inside a text are ordinary text.  An empty text has the empty list,
    a null text a null.  No shuffle unless the input has fewer splits than cores; ``vocabulary`` must exist under that path on the executors.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):  # about 4 MB of text at a time, however long single texts are
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end] or "")
                    end += 1
                ids = own.encode_batch(texts[at:end])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])
                at = end

    return spread(docs.select("doc_id", "text")).mapInArrow(encode, "doc_id bigint, ids array<int>")
