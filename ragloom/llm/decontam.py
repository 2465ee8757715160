"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are normalised alike: lower case, every run of white
space one space, none at the ends. An item of L characters occurs in a text if
it aligns to some part of it with at most `edits(L)` edits. By the q-gram lemma
such a part shares at least L - q + 1 - q * e of the item's q-grams with it, at
diagonals that differ by at most e. Shared q-grams are found through a hash
table of the items' q-grams, counted for each item in bands of diagonals that
overlap by half, and regions that meet the bound are verified by an alignment
confined to the band.

The items' table is broadcast in blocks of at most BLOCK_CHARS characters, each
of which goes over the texts once, so that what is broadcast has a fixed bound
however large the benchmark is.

Items of fewer than q characters have no edit budget: they are found as exact
parts, through a table of the items of each length.

Defined cases: null and empty texts hold nothing. Items that are null, have a
null id or are empty after normalising are not searched for.
Equal items are found each under its own id. Repeated rows are judged each for
itself; a row with a null id is judged too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Characters of a gram, and edits allowed for each character of an item.
Q, RATE = 8, 0.1
#: Characters of items broadcast at once.
BLOCK_CHARS = 4 << 20
_TABLE_BITS = 22
_MULT = util.U64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edits(length: int, q: int = Q, rate: float = RATE) -> int:
    """The edit budget of an item: its share, but no more than leaves the lemma a gram to ask for."""
    return max(0, min(int(length * rate), (length - q) // q))


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams by doubling; equal grams are told apart by all 64 bits, and filtered by the upper ones."""
    h, have = codes.astype(util.U64), 1
    h *= _MULT
    done, shift = None, 0
    n = max(len(codes) - q + 1, 0)
    while True:
        if q & have:
            part = h[shift : shift + n]
            done = part.copy() if done is None else done * _MULT + part
            shift += have
        if 2 * have > q:
            return done
        h = (h[:-have] * _MULT) + h[have:] if len(h) > have else h[:0]
        h ^= h >> util.U64(29)
        have *= 2


class Items:
    """Benchmark items with a table of their q-grams: sorted hashes with (item, place) of each."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, rate: float = RATE):
        named = sorted((i, t) for i, t in ((i, normalise(t)) for i, t in zip(ids, texts, strict=True)) if i is not None and t)
        keep = [(i, t) for i, t in named if len(t) >= q]
        self.short: dict[int, dict[str, list[int]]] = {}
        for i, t in named:
            if len(t) < q:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)
        self.q, self.ids, self.texts = q, np.array([i for i, _ in keep], np.int64), [np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, t in keep]
        self.plain = [t for _, t in keep]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array([edits(int(n), q, rate) for n in self.length], np.int64)
        self.least = self.length - q + 1 - q * self.budget
        self.width = np.maximum(self.budget, 4)
        h = [_grams(t, q) for t in self.texts]
        flat = np.concatenate([np.zeros(0, util.U64), *h])
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in h)])
        order = np.argsort(flat, kind="stable")
        self.hash, self.item, self.place = flat[order], item[order], place[order]
        self.first, self.start = np.unique(self.hash, return_index=True)
        self.count = np.diff(np.append(self.start, len(self.hash)))
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[(self.first >> util.U64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in codes, item, place in item) of shared q-grams."""
        h = _grams(codes, self.q)
        at = np.flatnonzero(self.maybe[(h >> util.U64(64 - _TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.first, h[at]), max(len(self.first) - 1, 0))
        ok = self.first[k] == h[at] if len(self.first) else np.zeros(0, bool)
        at, k = at[ok], k[ok]
        n = self.count[k]
        of = np.repeat(np.arange(len(at)), n)
        e = np.arange(len(of)) - (np.cumsum(n) - n)[of] + self.start[k][of]
        return at[of], self.item[e], self.place[e]

    def whole(self, norm: list[str], codes: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, start, end, 0): each short item at its first place in each text."""
        for n, plain in self.short.items():
            first = np.unique(np.array([_grams(np.frombuffer(t.encode("utf-32-le"), np.uint32), n)[0] for t in plain], util.U64))
            h = _grams(codes, n)
            k = np.minimum(np.searchsorted(first, h), len(first) - 1)
            at = np.flatnonzero(first[k] == h)
            doc = np.searchsorted(off, at, "right") - 1
            inside = at + n <= off[doc + 1]
            at, k, doc = at[inside], k[at][inside], doc[inside]
            _, new = np.unique(doc * len(first) + k, return_index=True)
            for d, a in zip(doc[new].tolist(), (at - off[doc])[new].tolist(), strict=True):
                for i in plain.get(norm[d][a : a + n], ()):
                    yield d, i, a, a + n, 0

    def regions(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, band's first diagonal) where a band of diagonals holds enough of an item's q-grams.

        A band takes up two widths and begins at every multiple of one, so that any diagonals within a width of each
        other lie in one band. Diagonals are counted from the document's start, less the item's length so that none
        is negative.
        """
        at, item, place = self.hits(codes)
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + self.q <= off[doc + 1]
        at, item, place, doc = at[inside], item[inside], place[inside], doc[inside]
        # What a whole text shares with an item bounds what any band of it does: most chance hits end here.
        pair = doc * len(self.ids) + item
        if (len(off) - 1) * len(self.ids) <= 1 << 24:
            shared = np.bincount(pair, minlength=1)[pair]
        else:
            _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
            shared = n[back]
        enough = shared >= self.least[item]
        at, item, place, doc = at[enough], item[enough], place[enough], doc[enough]
        diagonal = at - off[doc] - place + self.length[item]
        low = diagonal // self.width[item]
        out = []
        for band in (low, low - 1):
            # Distinct places of the item: a gram counts once, however often it stands in the band.
            order = np.lexsort((place, band, item, doc))
            d, i, b, p = doc[order], item[order], band[order], place[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            other = new.copy()
            other[1:] |= p[1:] != p[:-1]
            start = np.flatnonzero(new)
            n = np.add.reduceat(other.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
            good = start[n >= np.maximum(1, self.least[i[start]])]
            # Bands that begin at even and odd multiples come from either pass.
            out.append(np.stack([d[good], i[good], b[good] * self.width[i[good]]], 1))
        return tuple(np.unique(np.concatenate(out), axis=0).T)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of all of item to part of text on diagonals low to high (text minus item place).

    Of equally good ones that which ends first, and begins last.
    """
    width = high - low + 1
    big = len(item) + len(text) + 2
    j = np.arange(width)
    ramp = j * 1
    cost = np.where((low + j >= 0) & (low + j <= len(text)), 0, big)
    begin = low + j
    for i in range(1, len(item) + 1):
        col = i + low + j  # characters of text taken
        ok = (col >= 1) & (col <= len(text))
        swap = cost + np.where(ok, text[np.clip(col - 1, 0, max(len(text) - 1, 0))] != item[i - 1] if len(text) else 1, big)
        drop = np.append(cost[1:], big) + 1  # the item's character has none in the text
        now, frm = np.where(drop < swap, drop, swap), np.where(drop < swap, np.append(begin[1:], 0), begin)
        now = np.where((col >= 0) & (col <= len(text)), now, big)
        best = np.minimum.accumulate(now - ramp)
        src = np.maximum.accumulate(np.where(now - ramp == best, j, 0))
        src = np.where(now - ramp == best, j, src)
        cost, begin = best + ramp, frm[src]
        cost = np.where((col >= 0) & (col <= len(text)), cost, big)
    k = int(np.argmin(cost))
    return int(cost[k]), int(begin[k]), int(len(item) + low + k)


def find(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, edits): every item that occurs, best of its places, in normalised characters."""
    norm = [normalise(t) for t in texts]
    codes = np.frombuffer("".join(norm).encode("utf-32-le"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in norm])]).astype(np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, b in zip(*(x.tolist() for x in items.regions(codes, off)), strict=True):
        if best.get((d, i), (1,))[0] == 0:
            continue
        if (at := norm[d].find(items.plain[i])) >= 0:  # no alignment is better than the first whole copy
            best[d, i] = 0, at, at + len(items.plain[i])
            continue
        length, e, w = int(items.length[i]), int(items.budget[i]), int(items.width[i])
        lo = b - length
        text = codes[off[d] : off[d + 1]]
        # Only the part that these diagonals can reach.
        a = max(0, lo - e)
        part = text[a : max(a, min(len(text), lo + 2 * w + length + e))]
        n, start, end = align(items.texts[i], part, lo - e - a, lo + 2 * w - 1 + e - a)
        if n <= e and (n, start + a, end + a) < best.get((d, i), (e + 1, 0, 0)):
            best[d, i] = n, start + a, end + a
    found = [(d, int(items.ids[i]), start, end, n) for (d, i), (n, start, end) in sorted(best.items())]
    return sorted([*found, *items.whole(norm, codes, off)]) if items.short else found


def item_blocks(benchmark: DataFrame, q: int = Q, rate: float = RATE) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_CHARS characters (or one item)."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        if ids and size + len(r.text) > BLOCK_CHARS:
            yield Items(ids, texts, q, rate)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    yield Items(ids, texts, q, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each benchmark item that occurs in a row of docs."""
    spark = docs.sparkSession
    util.small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    out = None
    for items in item_blocks(benchmark, q, rate):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in util.pieces(batches):
                found = find(shared.value, b.column("text").to_pylist())
                ids = b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], pa.int64()) for k in range(1, 5))], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns as they are."""
    util.small_batches(docs.sparkSession)
    out, at = docs, docs.columns.index("text")
    for items in item_blocks(benchmark, q, rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b, texts in util.slices(batches, at):
                bad = {x[0] for x in find(shared.value, texts)}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)]))

        out = out.mapInArrow(run, docs.schema)
    return out
