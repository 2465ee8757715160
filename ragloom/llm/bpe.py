"""Byte-level BPE encoding and decoding by a public rank file.

Pieces of the split pattern are looked up in a bounded cache. Those not in it
are bucketed by byte length and put into padded matrices, a row for each piece.
In every round each row merges its leftmost pair of minimum rank, found through
a hashed pair table, and closes the gap; rows without a mergeable pair leave.
A piece of more than LONG bytes would take as many rounds as it has bytes over
rows as wide, so it is merged in the same order with a heap instead.

Defined cases: a null text is the empty text, with no ids. Repeated rows are
encoded each for itself. The columns asked for are read; others may have any
name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import util

#: Pieces kept with their ids in a worker; the cache is emptied when it is full.
CACHE = 300_000
#: Bytes from which on a piece is merged with a heap.
LONG = 256
#: Cells of one matrix.
CELLS = 1 << 20

_NONE = np.int32(2**31 - 1)
_loaded: dict[tuple[str, str], Bpe] = {}


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = dict((v, k) for k, v in self.ranks.items())
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        get = self.ranks.get
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = get(t[:k]), get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._table(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(rank, np.int32))
        self.cache: dict[str, bytes] = {}

    def _table(self, key: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing: every pair sits in the first slot after its hash that was free."""
        self.bits = max(10, int(len(key) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.vals = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] < 0]
            s, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[s], self.vals[s] = key[put], rank[put]
            done = np.zeros(len(key), bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each pair merges into, else the largest int; -1 is padding."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        flat = key.ravel()
        out = np.full(len(flat), _NONE, np.int32)
        at = np.flatnonzero((flat >= 0) & (b.ravel() >= 0))
        slot = self._slot(flat[at])
        for _ in range(self.probes):
            seen = self.keys[slot]
            hit = seen == flat[at]
            out[at[hit]] = self.vals[slot[hit]]
            more = ~hit & (seen >= 0)
            at, slot = at[more], (slot[more] + 1) & (len(self.keys) - 1)
            if not len(at):
                break
        return out.reshape(key.shape)

    def merge_matrix(self, m: np.ndarray) -> np.ndarray:
        """Merge the rows of a matrix of byte ids, padded with -1, until none has a pair left."""
        out, rows = m.copy(), np.arange(len(m))
        m = m.copy()
        r = self.pair_rank(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.full((len(m), 0), _NONE, np.int32)
        while len(rows) and r.shape[1]:
            j = r.argmin(1)
            low = r[np.arange(len(r)), j]
            over = low == _NONE
            if over.any():
                out[rows[over]] = -1
                out[rows[over], : m.shape[1]] = m[over]
                keep = ~over
                rows, m, r, j, low = rows[keep], m[keep], r[keep], j[keep], low[keep]
                if not len(rows):
                    break
            i = np.arange(len(rows))
            m[i, j] = low
            width = m.shape[1]
            col = np.arange(width - 1)
            take = col + (col > j[:, None])
            m = np.take_along_axis(m, take, 1)
            if width == 2:
                out[rows] = -1
                out[rows, :1] = m
                break
            # A pair at column c is of m[c] and m[c + 1]: the merged one is gone, its two neighbours are new.
            pair = col[:-1]
            r = np.take_along_axis(r, pair + (pair > j[:, None]), 1)
            last = r.shape[1] - 1
            right = j <= last
            r[i[right], j[right]] = self.pair_rank(m[i[right], j[right]], m[i[right], j[right] + 1])
            left = j > 0
            r[i[left], j[left] - 1] = self.pair_rank(m[i[left], j[left] - 1], m[i[left], j[left]])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = [int(x) for x in self.byte[np.frombuffer(piece, np.uint8)]]
        text = [piece[i : i + 1] for i in range(len(piece))]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < len(ids):
                both = text[i] + text[nxt[i]]
                if (k := self.ranks.get(both)) is not None:
                    heapq.heappush(heap, (k, i, both))

        for i in range(len(ids)):
            push(i)
        alive = [True] * len(ids)
        while heap:
            k, i, both = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= len(ids) or text[i] + text[nxt[i]] != both:
                continue
            gone = nxt[i]
            alive[gone], ids[i], text[i], nxt[i] = False, k, both, nxt[gone]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        return [k for k, a in zip(ids, alive, strict=True) if a]

    def encode_pieces(self, found: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, bucketed by length."""
        out: list = [None] * len(found)
        by: dict[int, list[int]] = {}
        for n, p in enumerate(found):
            if (k := self.ranks.get(p)) is not None:
                out[n] = np.array([k], np.int32)
            elif len(p) > LONG:
                out[n] = np.array(self.merge_long(p), np.int32)
            else:
                by.setdefault(-(-len(p) // 4) * 4, []).append(n)
        for width, at in by.items():
            step = max(1, CELLS // width)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                m = np.full((len(some), width), -1, np.int32)
                size = np.array([len(found[n]) for n in some])
                m[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(found[n] for n in some), np.uint8)]
                merged = self.merge_matrix(m)
                n_ids = (merged >= 0).sum(1)
                for n, row, c in zip(some, merged, n_ids.tolist(), strict=True):
                    out[n] = row[:c]
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        cache = self.cache
        new: set[str] = set()
        for s in split:
            new.update(s)
        if len(cache) + len(new) > CACHE:
            cache.clear()
        found = [p for p in new if p not in cache]
        for p, ids in zip(found, self.encode_pieces([p.encode() for p in found]), strict=True):
            cache[p] = ids.astype("<u4").tobytes()
        return [b"".join(map(cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str, pattern: str) -> Bpe:
    """One for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with keep_ids also ids (array) and decoded (binary).

    vocabulary: the rank file's path, which every executor must have.
    """
    util.small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for b in util.pieces(batches):
            ids = bpe.encode_texts(b.column("text").to_pylist())
            plain = [bpe.decode(x) for x in ids]
            cols = [
                b.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
            ]
            if keep_ids:
                cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(plain, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
