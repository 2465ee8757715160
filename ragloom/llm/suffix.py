"""Removal of repeated byte strings by suffix order.

Every byte covered by a string of `length` bytes that also starts in a document
with a smaller id is removed, judged on the input.

How the work is dealt out. Two equal windows of `length` bytes hold the same
anchor: their smallest hashed gram of GRAM bytes (the leftmost of several), at
the same place. So a window need only meet the windows of its anchor's hash:

1. Whole texts that occur more than once are represented by their smallest id;
   of the others all windows repeat.
2. Texts are dealt into groups as compressed blocks, written once. Each group
   sends its distinct anchor hashes to the hashes' buckets, which answer, in the order
   sent, which are found in other texts too.
3. For those anchors each group sends the texts of the windows they stand for,
   once for each distinct text, with the smallest id that has it. A bucket puts
   them into buffers of bounded size, all those of an anchor into one, orders
   all window starts by suffix, and answers each with the smallest id among
   equal windows. Texts are told apart by 128 bits of hash.
4. Each group covers the bytes of windows that a smaller id has.

Suffix order is built blockwise over a difference cover: the suffixes at the
cover's places are ranked once; then one bucket of suffixes (by first bytes) is
sorted at a time by as many bytes as the cover's period, and ties that long are
resolved by the ranks of two places, equally far ahead, that the cover holds.
Where only so many bytes matter, ranks go no deeper.

A hot passage costs a bucket one entry for each group, not for each document.

Defined cases: a null text is the empty text. Texts shorter than `length` keep
every byte. A null id is smaller and larger than no id: its row keeps all its
bytes and is no source. Rows that repeat an id are rows of their own and remove
nothing from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Bytes of a gram from whose hashes anchors are chosen.
GRAM = 20
#: Bytes of text of a group, on average, and of the text whose anchors a bucket gets.
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: The cover's period; differences of its places are all residues.
PERIOD = 32
#: Suffixes sorted at once.
BLOCK = 1 << 18
#: Bytes of windows' texts whose suffixes are ordered in one buffer, and of text whose anchors are looked for at once.
BUFFER, SLAB = 1 << 20, 1 << 20
_SEPARATOR = 255  # in no UTF-8 text
_CODEC = "zstd"


def difference_cover(v: int = PERIOD) -> np.ndarray:
    """Residues such that every residue is a difference of two of them: small steps, then large ones."""
    r = int(np.ceil(np.sqrt(v)))
    return np.unique(np.concatenate([np.arange(r), np.arange(r - 1, v, r) % v, [v - 1]]))


def _words(text: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The depth bytes from each place as big-endian 64-bit words; text must be padded by depth bytes."""
    word = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return [word[at + k].astype(np.uint64) for k in range(0, depth, 8)]


def cover_ranks(text: np.ndarray, n: int, v: int = PERIOD, depth: int | None = None) -> np.ndarray:
    """For each place of the cover in text[:n], the rank of its suffix among the cover's, by depth bytes at least; -1 elsewhere.

    Prefix doubling over the cover's places alone: k periods ahead of a place is a place again.
    """
    place = np.flatnonzero(np.isin(np.arange(n) % v, difference_cover(v)))
    rank = np.full(n + 1, -1, np.int64)
    if not len(place):
        return rank
    # Past the end stand zeros; where they tie with zeros of the text, the shorter suffix comes first.
    words = [*_words(text, place, v), np.minimum(n - place, v)]
    order = np.lexsort(words[::-1])
    step = v
    new = np.zeros(len(place), bool)
    for w in words:
        new[1:] |= w[order[1:]] != w[order[:-1]]
    while True:
        value = np.empty(len(place), np.int64)
        value[order] = np.cumsum(new)
        rank[place] = value
        if value.max() == len(place) - 1 or step >= (depth or n + v):
            return rank
        ahead = np.where(place + step < n, rank[np.minimum(place + step, n)], -1)
        order = np.lexsort((ahead, value))
        new = np.zeros(len(place), bool)
        new[1:] = (value[order[1:]] != value[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]])
        step *= 2


def suffix_blocks(data: bytes | np.ndarray, starts: np.ndarray | None = None, v: int = PERIOD, block: int = BLOCK, depth: int | None = None) -> Iterator[np.ndarray]:
    """The suffixes at starts (all, if None) in order, a bucket at a time, so that only the cover's ranks and one bucket are held.

    depth: so many bytes decide (all, if None); suffixes that agree in them stand together.
    """
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = len(raw)
    text = np.zeros(n + 2 * v + 8, np.uint8)
    text[:n] = raw
    cover = difference_cover(v)
    # ahead[i][j]: how far on both i and j are in the cover.
    ahead = np.full((v, v), v, np.int64)
    for d in range(v):
        moved = np.isin((np.arange(v) + d) % v, cover)
        ahead = np.where((ahead == v) & moved[:, None] & moved[None, :], d, ahead)
    rank = cover_ranks(text, n, v, depth)
    starts = np.arange(n) if starts is None else starts
    lead = _words(text, starts, 8)[0]
    # Buckets by the leading bytes, of about `block` suffixes; one leading value is never split.
    by = np.argsort(lead, kind="stable")
    edge = np.concatenate([[0], np.flatnonzero(lead[by[1:]] != lead[by[:-1]]) + 1, [len(by)]]) if len(by) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(by):
        hi = int(edge[max(np.searchsorted(edge, lo + block, "right") - 1, np.searchsorted(edge, lo, "right"))])
        s = starts[by[lo:hi]]
        lo = hi
        words = _words(text, s, v)
        order = np.lexsort(words[::-1])
        same = np.ones(len(s) - 1, bool)
        for w in words:
            same &= w[order[1:]] == w[order[:-1]]
        s = s[order]
        yield _resolve(s, same, n, rank, ahead, v)


def _resolve(s: np.ndarray, same: np.ndarray, n: int, rank: np.ndarray, ahead: np.ndarray, v: int) -> np.ndarray:
    """Order the runs of suffixes that agree in v bytes: by the ranks at a shift that brings all of a run into the cover."""
    if not same.any():
        return s
    run = np.concatenate([[0], np.cumsum(~same)])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    in_cover = np.isin(np.arange(v), difference_cover(v))
    bits = np.array([sum(1 << d for d in range(v) if in_cover[(r + d) % v]) for r in range(v)], np.int64)
    common = np.bitwise_and.reduceat(bits[s % v], first)
    shift = np.log2(np.maximum(common & -common, 1)).astype(np.int64)
    at = s + shift[run]
    key = np.where(at < n, rank[np.minimum(at, n)], -1 - at)
    out = s[np.lexsort((key, run))]
    size = np.diff(np.append(first, len(s)))
    for f, c in zip(first[(common == 0) & (size > 1)], size[(common == 0) & (size > 1)], strict=True):
        out[f : f + c] = _merge(s[f : f + c], n, rank, ahead)
    return out


def _merge(part: np.ndarray, n: int, rank: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """A run whose residues have no common shift: any two of its suffixes still have one."""

    def less(i: int, j: int) -> int:
        d = ahead[i % len(ahead), j % len(ahead)]
        a = rank[i + d] if i + d < n else -1 - (i + d)
        b = rank[j + d] if j + d < n else -1 - (j + d)
        return -1 if a < b else 1 if a > b else 0

    return np.array(sorted(part.tolist(), key=cmp_to_key(less)), part.dtype)


def equal_runs(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of an ordered bucket agrees with the one before in `length` bytes, which text holds from each."""
    same = np.ones(max(len(order) - 1, 0), bool)
    if length < 8:
        for k in range(length):
            same &= text[order[1:] + k] == text[order[:-1] + k]
        return same
    word = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    for k in (length - 8, *range(0, length - 8, 8)):  # the last bytes differ most often
        at = np.flatnonzero(same)
        same[at] = word[order[at + 1] + k] == word[order[at] + k]
    return same


def smallest_ids(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int, anchor: np.ndarray | None = None) -> np.ndarray:
    """For each window of each text raw[begin : begin + size], in order, the smallest of the ids of the texts that hold an equal window.

    anchor: a place in each text that equal windows have in common. Texts are laid out so that it falls on the cover's
    period: suffixes that tie then have one residue, and so a common shift.
    """
    lead = (-(anchor if anchor is not None else np.zeros(len(size), np.int64))) % PERIOD
    slot = -(-(lead + size + 1) // PERIOD) * PERIOD
    place = np.cumsum(slot) - slot + lead
    data = np.full(int(slot.sum()), _SEPARATOR, np.uint8)
    data[_ranges(place, size)] = raw[_ranges(begin, size)]
    windows = np.maximum(size - length + 1, 0)
    of = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    starts = _ranges(place, windows)
    who = np.zeros(len(data) + 1, np.int32)
    who[starts] = np.arange(len(starts))
    low = np.empty(len(starts), np.int64)
    for order in suffix_blocks(data, starts, depth=length):
        edge = np.concatenate([[True], ~equal_runs(data, order, length)])
        at = np.flatnonzero(edge)
        mine = who[order]
        low[mine] = np.repeat(np.minimum.reduceat(ids[of[mine]], at), np.diff(np.append(at, len(order))))
    return low


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + begin[of]


def anchors(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of buf, where its anchor is: the leftmost of the grams of least hash; and that hash.

    Hashes that agree in their upper bits count as equal: the lower ones give way to the place.
    """
    g = min(GRAM, length)
    value = util.gram_hash(buf, g)
    w = length - g + 1  # grams in a window
    low = util.U64((1 << max(len(value), 1).bit_length()) - 1)
    least = (value & ~low) | np.arange(len(value), dtype=util.U64)
    k = 1
    while 2 * k <= w:
        least = np.minimum(least[k:], least[:-k])
        k *= 2
    if k < w:
        least = np.minimum(least[w - k :], least[: k - w])
    place = (least & low).astype(np.int64)
    return place, value[place]


def _identity(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """128 bits (two columns) that tell texts buf[start:end] with their anchors' places apart."""
    out = np.empty((len(start), 2), util.U64)
    for k in range(2):
        code = util.mix(np.arange(256 * k, 256 * k + 256, dtype=util.U64))
        out[:, k] = util.mix(util.span_hash(code[buf], start, end) + lead.astype(util.U64) * util.U64(0x9E3779B97F4A7C15))
    return out


class _Group:
    """A group's distinct texts in one buffer, and its runs of windows that stand at one anchor: anchor's hash and place, first window and the one after the last."""

    def __init__(self, parts, length: int):
        rows = _unpack(parts)
        self.length = length
        self.sha, self.ids = [r[0] for r in rows], np.array([r[2] for r in rows], np.int64)
        self.off = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int64)
        self.raw = b"".join(r[1] for r in rows)
        del rows
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.slabs = [(a, min(a + SLAB, len(self.buf))) for a in range(0, len(self.buf), SLAB)]
        found = [self._runs(a, z) for a, z in self.slabs]
        empty = [(np.zeros(0, util.U64), *np.zeros((3, 0), np.int64))]
        self.head, self.place, self.lo, self.hi = (np.concatenate(x) for x in zip(*(found or empty), strict=True))
        self.text = np.searchsorted(self.off, self.lo, "right") - 1

    def _runs(self, a: int, z: int) -> tuple:
        """Runs of the windows that begin in buf[a:z]; a run that goes on after z is cut there."""
        buf = self.buf[a : z + self.length - 1]
        if len(buf) < self.length:
            return (np.zeros(0, util.U64), *np.zeros((3, 0), np.int64))
        place, value = anchors(buf, self.length)
        ends = self.off[np.searchsorted(self.off, a, "right") : np.searchsorted(self.off, a + len(buf), "left")] - a
        over = np.zeros(len(buf) + 1, np.int32)  # windows that hold an end of a text
        np.add.at(over, np.maximum(ends - self.length + 1, 0), 1)
        np.add.at(over, ends, -1)
        fits = np.cumsum(over)[: len(place)] == 0
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~fits[:-1]
        at = np.flatnonzero(new & fits)
        stop = np.flatnonzero(np.append(new[1:] | ~fits[1:], True) & fits) + 1
        return value[at], *(x + a for x in (place[at], at, stop))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchor hashes, sorted; whether several of the texts have each."""
        order = np.argsort(self.head, kind="stable")  # texts stay in order
        h, t = self.head[order], self.text[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[at], t[at] < t[np.append(at[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)

    def shared(self, answers: pd.DataFrame, buckets: int) -> np.ndarray:
        """The anchor hashes that other texts have too."""
        u, _ = self.hashes()
        cut = _cut(u, buckets)
        keep = np.zeros(len(u), bool)
        for frm, part in zip(answers["frm"], answers["part"], strict=True):
            lo, hi = cut[frm], cut[frm + 1]
            keep[lo:hi] = np.unpackbits(np.frombuffer(_unzip(part), np.uint8), count=hi - lo)
        return u[keep]

    def contexts(self, shared: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs at shared anchors by bucket and identity; for each which text of the windows it has; of these the first run and the bucket."""
        if not len(shared) or not len(self.head):
            return tuple(np.zeros((4, 0), np.int64))
        at = np.minimum(np.searchsorted(shared, self.head), len(shared) - 1)
        k = np.flatnonzero(shared[at] == self.head)
        name = np.empty((len(k), 2), util.U64)
        for a, z in self.slabs:
            i, j = np.searchsorted(self.lo[k], [a, z])
            r = k[i:j]
            name[i:j] = _identity(self.buf[a : z + self.length - 1], self.lo[r] - a, self.hi[r] + self.length - 1 - a, self.place[r] - self.lo[r])
        bucket = np.searchsorted(_edges(buckets), self.head[k], "right")
        order = np.lexsort((name[:, 1], name[:, 0], bucket))
        k, name, bucket = k[order], name[order], bucket[order]
        new = np.append(True, (name[1:] != name[:-1]).any(1) | (bucket[1:] != bucket[:-1]))
        return k, np.cumsum(new) - 1, k[new], bucket[new]


def _edges(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(1, buckets)], util.U64)


def _blocks(docs: DataFrame, groups: int) -> DataFrame:
    """(g, part): compressed blocks of texts that are distinct within the block, with sha256, smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for sha, (text, low) in held.items():
                by.setdefault(int.from_bytes(sha[:8], "big") % groups, []).append((sha, text, low))
            for g, rows in by.items():
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "part": pa.array([_pack(rows)], pa.binary())})

        for b in util.pieces(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = t.encode()
                sha = hashlib.sha256(raw).digest()
                if sha in held:
                    held[sha][1] = min(held[sha][1], i)
                else:
                    held[sha] = [raw, i]
                    size += len(raw)
            if size > 2 * GROUP_BYTES:
                yield from out()
                held.clear()
                size = 0
        yield from out()

    return docs.mapInArrow(run, "g int, part binary")


def _pack(rows: list[tuple[bytes, bytes, int]]) -> bytes:
    head = np.array([len(rows)], "<i8").tobytes() + np.array([[r[2], len(r[1])] for r in rows], "<i8").tobytes()
    raw = head + b"".join(r[0] for r in rows) + b"".join(r[1] for r in rows)
    return np.array([len(raw)], "<i8").tobytes() + pa.Codec(_CODEC).compress(raw, asbytes=True)


def _unpack(parts) -> list[tuple[bytes, bytes, int]]:
    """The distinct texts of a group's blocks with their smallest ids, by sha256."""
    held: dict[bytes, list] = {}
    for part in parts:
        raw = pa.Codec(_CODEC).decompress(part[8:], int(np.frombuffer(part[:8], "<i8")[0]), asbytes=True)
        n = int(np.frombuffer(raw[:8], "<i8")[0])
        meta = np.frombuffer(raw[8 : 8 + 16 * n], "<i8").reshape(n, 2)
        sha_at, at = 8 + 16 * n, 8 + 48 * n
        for k, (low, size) in enumerate(meta.tolist()):
            sha = raw[sha_at + 32 * k : sha_at + 32 * k + 32]
            if sha in held:
                held[sha][1] = min(held[sha][1], low)
            else:
                held[sha] = [raw[at : at + size], low]
            at += size
    return [(sha, text, low) for sha, (text, low) in sorted(held.items())]


def _cut(u: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted hashes begins; one more for the end."""
    return np.concatenate([[0], np.searchsorted(u, _edges(buckets)), [len(u)]]).astype(np.int64)


def _zip(raw: bytes) -> bytes:
    return np.array([len(raw)], "<i8").tobytes() + pa.Codec(_CODEC).compress(raw, asbytes=True)


def _unzip(z: bytes) -> bytes:
    return pa.Codec(_CODEC).decompress(z[8:], int(np.frombuffer(z[:8], "<i8")[0]), asbytes=True)


_ROW = "to int, frm int, part binary"


def _send_hashes(length: int, buckets: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        u, several = _Group(g["part"], length).hashes()
        cut = _cut(u, buckets)
        out = []
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if hi > lo:
                # Six bytes of each hash tell it from the others of its bucket; a mistake only makes a candidate.
                six = u[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                out.append((b, int(key[0]), np.packbits(several[lo:hi]).tobytes() + six + np.array([hi - lo], "<i8").tobytes()))
        util.give_back()
        return pd.DataFrame(out, columns=["to", "frm", "part"])

    return run


def _read_hashes(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(part[-8:], "<i8")[0])
    bits = np.unpackbits(np.frombuffer(part[: -(-n // 8)], np.uint8), count=n).astype(bool)
    six = np.zeros((n, 8), np.uint8)
    six[:, :6] = np.frombuffer(part[-(-n // 8) : -8], np.uint8).reshape(n, 6)
    return six.view(">u8").ravel().astype(util.U64), bits


def _answer_hashes(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Which hashes of each sender are shared, in the order sent."""
    got = [_read_hashes(p) for p in g["part"]]
    u, back, n = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True, return_counts=True)
    several = n > 1
    several[back[np.concatenate([s for _, s in got])]] = True
    out, at = [], 0
    for frm, (x, _) in zip(g["frm"], got, strict=True):
        out.append((int(frm), int(key[0]), _zip(np.packbits(several[back[at : at + len(x)]]).tobytes())))
        at += len(x)
    util.give_back()
    return pd.DataFrame(out, columns=["to", "frm", "part"])


def _send_contexts(length: int, buckets: int):
    def run(key: tuple, g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _Group(g["part"], length)
        k, of, first, bucket = own.contexts(own.shared(answers, buckets), buckets)
        out = []
        if len(k):
            low = np.minimum.reduceat(own.ids[own.text[k]], np.flatnonzero(np.diff(of, prepend=-1)))
            size, lead = own.hi[first] - own.lo[first] + length - 1, own.place[first] - own.lo[first]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                head = np.array([hi - lo], "<i8").tobytes() + low[lo:hi].astype("<i8").tobytes() + size[lo:hi].astype("<i4").tobytes() + lead[lo:hi].astype("<i4").tobytes()
                out.append((int(bucket[lo]), int(key[0]), _zip(head + own.buf[_ranges(own.lo[first[lo:hi]], size[lo:hi])].tobytes())))
        del own
        util.give_back()
        return pd.DataFrame(out, columns=["to", "frm", "part"])

    return run


def _answer_contexts(length: int):
    """The smallest ids of each sender's windows, in the order sent."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        sent, at = [], 0
        for part in g["part"]:
            raw = _unzip(part)
            n = int(np.frombuffer(raw[:8], "<i8")[0])
            low, size, lead = np.frombuffer(raw, "<i8", n, 8), *(np.frombuffer(raw, "<i4", n, 8 + (8 + 4 * k) * n).astype(np.int64) for k in range(2))
            buf = np.frombuffer(raw, np.uint8, offset=8 + 16 * n)
            start = np.cumsum(size) - size
            gram = util.span_hash(buf, start + lead, start + lead + min(GRAM, length))
            sent.append((_identity(buf, start, start + size, lead), gram, low, size, lead, start + at, buf))
            at += len(buf)
        name, gram, low, size, lead, start, raw = (np.concatenate(x) for x in zip(*sent, strict=True))
        count = [len(x[0]) for x in sent]
        del sent
        # Each text once, those of an anchor together.
        order = np.lexsort((name[:, 1], name[:, 0], gram))
        new = np.append(True, (name[order[1:]] != name[order[:-1]]).any(1))
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(low[order], np.flatnonzero(new))
        once = order[new]
        del name, order, new
        gram, size, lead, start = gram[once], size[once], lead[once], start[once]
        windows = size - length + 1
        to = np.cumsum(windows)
        found = np.empty(int(to[-1]), np.int64)
        ends, sum_ = np.flatnonzero(np.append(gram[1:] != gram[:-1], True)) + 1, np.cumsum(size)
        lo = 0
        while lo < len(once):
            most = np.searchsorted(sum_, sum_[lo] - size[lo] + BUFFER, "right")
            i = max(int(np.searchsorted(ends, most, "right")) - 1, int(np.searchsorted(ends, lo, "right")))
            hi = int(ends[i])
            found[to[lo] - windows[lo] : to[hi - 1]] = smallest_ids(raw, start[lo:hi], size[lo:hi], low[lo:hi], length, lead[lo:hi])
            lo = hi
        del raw
        out, at = [], 0
        for frm, n in zip(g["frm"], count, strict=True):
            mine = of[at : at + n]
            at += n
            out.append((int(frm), int(key[0]), _zip(found[_ranges(to[mine] - windows[mine], windows[mine])].astype("<i8").tobytes())))
        util.give_back()
        return pd.DataFrame(out, columns=["to", "frm", "part"])

    return run


def _cover(length: int, buckets: int):
    """Rows for each text of a group: what is removed of it. A group's answers come as (kind, frm, part)."""

    def run(key: tuple, g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _Group(g["part"], length)
        k, of, first, _ = own.contexts(own.shared(answers[answers["kind"] == 0], buckets), buckets)
        hit = np.zeros(len(own.buf) + 1, np.int32)
        if len(k):
            got = answers[answers["kind"] == 1].sort_values("frm")
            least = np.concatenate([np.frombuffer(_unzip(part), "<i8") for part in got["part"]])
            each = own.hi[first] - own.lo[first]
            begin = np.cumsum(each) - each
            for lo in range(0, len(k), 1 << 16):
                r, c = k[lo : lo + (1 << 16)], of[lo : lo + (1 << 16)]
                n = each[c]
                at = _ranges(own.lo[r], n)
                hit[at[least[_ranges(begin[c], n)] < np.repeat(own.ids[own.text[r]], n)] + 1] = 1
            del least
        hit = np.cumsum(hit, dtype=np.int32)  # hit[i]: repeated windows before i
        gone = hit[1:] > np.append(np.zeros(length, np.int32), hit)[1 : len(hit)]
        out = []
        for sha, low, a, b in zip(own.sha, own.ids.tolist(), own.off[:-1].tolist(), own.off[1:].tolist(), strict=True):
            mine = gone[a:b]
            edge = np.flatnonzero(np.diff(mine.view(np.int8), prepend=0, append=0))
            kept = own.buf[a:b][~mine].tobytes() if len(edge) else own.raw[a:b]
            out.append((sha, low, b - a, int(mine.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist()))
        del own, hit, gone
        util.give_back()
        return pd.DataFrame(out, columns=["sha", "low", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with_spans: also edges (array of removed starts and ends)."""
    spark = docs.sparkSession
    util.small_batches(spark)
    raw = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("long").alias("n_bytes"))
    total = own.agg(F.sum("n_bytes")).first()[0] or 0
    groups, buckets = (util.parts_for(spark, total, n) for n in (GROUP_BYTES, BUCKET_BYTES))
    real = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = util.materialise(_blocks(real, groups), "blocks")
    texts = lambda: blocks.groupBy("g")
    answers = texts().applyInPandas(_send_hashes(length, buckets), _ROW).groupBy("to").applyInPandas(_answer_hashes, _ROW)
    answers = util.materialise(answers, "anchors")
    sent = texts().cogroup(answers.groupBy("to")).applyInPandas(_send_contexts(length, buckets), _ROW)
    found = util.materialise(sent.groupBy("to").applyInPandas(_answer_contexts(length), _ROW), "windows")
    both = answers.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))
    schema = "sha binary, low long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>"
    done = util.materialise(texts().cogroup(both.groupBy("to")).applyInPandas(_cover(length, buckets), schema), "kept").drop("n_bytes")
    out = own.join(done, "sha", "left")
    first = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("low"))
    whole = ~first & (F.col("n_bytes") >= length)  # a copy of a text with a smaller id
    null_id = F.col("doc_id").isNull()
    pick = lambda copy, other, c: F.when(whole, copy).when(null_id, other).otherwise(F.col(c))
    zero = F.lit(0).cast("long")
    cols = [
        F.col("doc_id"), F.col("n_bytes"), pick(F.col("n_bytes"), zero, "n_removed").alias("n_removed"), pick(F.lit(1).cast("long"), zero, "n_spans").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.lower(F.hex("sha")), "kept_sha256").alias("kept_sha256"),
    ]
    if with_spans:
        none = F.array().cast("array<long>")
        cols.append(pick(F.array(F.lit(0).cast("long"), F.col("n_bytes")), none, "edges").alias("edges"))
    return out.select(*cols)
