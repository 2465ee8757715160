"""Language-model scoring: corpus token counts, and a causal self-attention model.

The base score is an add-one unigram over the words of all training documents.
Texts are dealt into groups; each group is read once, keeps its texts as numbers
of its distinct words, and sends these with their training counts to the words'
buckets, which answer with the corpus counts and the subword ids in the order sent. A common word costs its bucket one entry for
each group, and is encoded once. What a bucket's words count for their ids adds
up to the id counts of all training documents.

The model reads subword ids of the lower-cased words (a public rank file's,
each word with a space before it) and an end after each text. It is a causal
self-attention layer over windows of WINDOW ids; windows overlap by OVERLAP, so
that each id is scored once, with at least that much context after the first
window. What it predicts is the id's class; within a class ids have their
smoothed frequency. Classes hold about equal shares of the corpus, so frequent
ids have classes of their own. It is trained in numpy in two steps: the driver
begins on the training documents with the smallest hash, SAMPLE_DOCS of them and
SAMPLE_IDS ids at most; from there each group goes once over all windows of its
training documents, and the model is the groups' mean, weighted by ids. The mean
depends on the number of groups, not on the order in which texts arrive.

Defined cases: a null or empty text is its end alone. A null id teaches nothing
and its held_out is null. Repeated rows count and are scored each for itself.
With no training documents N and V are 0 and the model is untrained.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util
from .bpe import load

WINDOW, OVERLAP = 16, 4
#: Documents and ids of the sample that training begins with; passes over it.
SAMPLE_DOCS, SAMPLE_IDS, EPOCHS = 800, 300_000, 5
#: Step size of a group's pass over its own windows.
RATE = 0.003
WIDTH, CLASSES, INPUTS = 16, 128, 1024
#: Bytes of text of a group, on average.
GROUP_BYTES = 8 << 20
_CODEC = "zstd"


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 7 == 2


_ONES = np.ones((WINDOW, WIDTH), np.float32)
#: Windows that pass through the layers at once: all they hold stays in the cache, and the products stay small enough for the kernels that copy nothing.
SOME = 40
#: Places of each input code's weights, two by two: added up as complex numbers, which takes half as many additions.
_PAIRS = np.arange(INPUTS * WIDTH // 2).reshape(INPUTS, -1)


def _exp(z: np.ndarray) -> None:
    """exp of z in place, each last axis up to a factor: its largest is taken away only where single precision could not hold it."""
    if z.size and not (z.max() < 60 and z.min() > -60):
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)


def _outer(a: np.ndarray, b: np.ndarray, some: int = 256) -> np.ndarray:
    """a.T @ b of long narrow matrices, in parts that stay in the cache."""
    n = len(a) // some * some
    whole = a[n:].T @ b[n:]
    if n:
        whole += (a[:n].reshape(-1, some, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, some, b.shape[1])).sum(0)
    return whole


def _odd(on: np.ndarray) -> np.ndarray:
    """Windows that score other places than all after the overlap; those of one kind are best passed together."""
    return on[:, 0] | ~on[:, OVERLAP:].all(1)


class Attention:
    """Vocabulary tables and weights. Ids beyond the vocabulary's last are the end."""

    def __init__(self, vocabulary: int, counts: np.ndarray | None = None, seed: int = 13):
        n = vocabulary + 1
        self.end = vocabulary
        counts = np.zeros(n) if counts is None else counts.astype(float)
        order = np.argsort(-counts, kind="stable")
        self.input = np.full(n, INPUTS - 1, np.int32)
        self.input[order[: INPUTS - 1]] = np.arange(min(n, INPUTS - 1))
        smooth = counts + 0.1
        share = np.cumsum(smooth[order]) / smooth.sum()
        self.klass = np.zeros(n, np.int32)
        self.klass[order] = np.minimum((share - smooth[order] / smooth.sum() / 2) * CLASSES, CLASSES - 1).astype(np.int32)
        self.klass = np.unique(self.klass, return_inverse=True)[1]  # a very frequent id leaves classes empty
        self.classes = int(self.klass.max()) + 1
        total = np.bincount(self.klass, smooth)
        self.within = np.log10(smooth / total[self.klass])
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": r.normal(0, 0.3, (INPUTS, WIDTH)).astype(np.float32), "pos": r.normal(0, 0.1, (WINDOW, WIDTH)).astype(np.float32)}
        self.p |= {k: draw(WIDTH, WIDTH) for k in ("q", "k", "v", "o")} | {"out": draw(WIDTH, self.classes), "bias": np.zeros(self.classes, np.float32)}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def ready(self) -> tuple[np.ndarray, np.ndarray]:
        """What forward makes of the weights alone: queries times keys and values times outputs, each as one product; exp of biases."""
        p = self.p
        return np.hstack([p["q"] @ p["k"].T * p["q"].dtype.type(WIDTH**-0.5), p["v"] @ p["o"]]), np.exp(p["bias"])

    def forward(self, x: np.ndarray, on: np.ndarray, ready: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """At the places of windows of input codes that are on, exp(score) of each class without its bias, up to a factor, and the sum with biases; what the way back needs."""
        p, (w, bias) = self.p, ready or self.ready()
        if np.count_nonzero(on) == len(x) * (WINDOW - OVERLAP) and not on[:, :OVERLAP].any():
            lo, at = OVERLAP, None  # all places from lo on ask, those before it are only asked
        else:
            lo, at = 0, np.flatnonzero(on)
        e = p["emb"].take(x.ravel(), 0).reshape(len(x), -1)
        e += p["pos"].ravel()
        e = e.reshape(len(x), WINDOW, WIDTH)
        v = (e.reshape(-1, WIDTH) @ w).reshape(len(x), WINDOW, -1)
        q, v = v[:, lo:, :WIDTH], v[:, :, WIDTH:]
        s = q @ e.transpose(0, 2, 1).copy()
        _exp(s)
        s *= self.mask[lo:]
        one = s.reshape(-1, WINDOW) @ _ONES
        np.reciprocal(one, out=one)
        o = s @ v
        o *= one.reshape(o.shape)
        h = (o + e[:, lo:]).reshape(-1, WIDTH)
        if at is not None:
            h = h.take(at, 0)
        with np.errstate(over="ignore"):
            z = h @ p["out"]
            np.exp(z, out=z)
            total = z @ bias
        if len(h) and not (total.max() < 1e30 and total.min() > 1e-26):
            z = h @ p["out"]
            _exp(z)
            total = z @ bias
        return z, total, (lo, at, e, q, v, s, o.reshape(-1, WIDTH), one, h, bias)

    def shares(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, ready: tuple) -> np.ndarray:
        """Probability of the classes y, one for each place that is on, over exp of their biases."""
        z, total, _ = self.forward(x, on, ready)
        place = np.arange(0, z.size, z.shape[1])
        place += y
        return z.ravel().take(place) / total

    def _add(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, n: int, ready: tuple, turned: tuple, sums: list[np.ndarray], de: np.ndarray) -> np.ndarray:
        """Add a part's gradients of out and bias, over exp(bias), and of the two products to sums; de becomes that of its inputs. Returns the probabilities of y."""
        z, total, (lo, at, e, q, v, s, o, one, h, bias) = self.forward(x, on, ready)
        mine = y[:, lo:].ravel()
        if at is not None:
            mine = mine.take(at)
        b, flat = bias.take(mine), z.ravel()
        place = np.arange(0, z.size, z.shape[1])
        place += mine
        mine = flat.take(place)
        # The scores' gradients times `total` and n, over exp(bias): what they meet has these factors instead.
        flat[place] = mine - total / b
        each = 1 / (total * total.dtype.type(n))
        dh = z @ turned[0]
        dh *= each[:, None]
        h *= each[:, None]
        sums[0] += _outer(h, z, 512)
        sums[1] += each @ z
        if at is not None:
            part, dh = dh, np.zeros_like(o)
            dh[at] = part
        do = dh * one
        o *= do
        do = do.reshape(len(x), -1, WIDTH)
        ds = do @ v.transpose(0, 2, 1).copy()
        ds -= (o @ _ONES.reshape(WIDTH, WINDOW)).reshape(ds.shape)
        ds *= s
        d = np.empty((len(x), WINDOW, 2 * WIDTH), e.dtype)
        d[:, :lo, :WIDTH] = 0
        np.matmul(ds, e, out=d[:, lo:, :WIDTH])
        np.matmul(s.transpose(0, 2, 1), do, out=d[:, :, WIDTH:])
        d = d.reshape(-1, 2 * WIDTH)
        sums[2] += e.reshape(-1, WIDTH).T @ d
        np.matmul(d, turned[1], out=de.reshape(-1, WIDTH))
        de += ds.transpose(0, 2, 1) @ q
        de[:, lo:] += dh.reshape(do.shape)
        return mine * b / total

    def loss(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of classes y where on, and its gradients."""
        p, ready, n = self.p, self.ready(), max(np.count_nonzero(on), 1)
        w, bias = ready
        turned = np.ascontiguousarray((p["out"] * bias).T), np.ascontiguousarray(w.T)
        sums, de = [np.zeros_like(p["out"]), np.zeros_like(bias), np.zeros_like(w)], np.empty((len(x), WINDOW, WIDTH), w.dtype)
        some = [slice(lo, lo + SOME) for lo in range(0, len(x), SOME)]
        got = [self._add(x[k], y[k], on[k], n, ready, turned, sums, de[k]) for k in some]
        qk, vo = sums[2][:, :WIDTH] * w.dtype.type(WIDTH**-0.5), sums[2][:, WIDTH:]
        g = {"out": sums[0] * bias, "bias": sums[1] * bias, "q": qk @ p["k"], "k": qk.T @ p["q"], "v": vo @ p["o"].T, "o": p["v"].T @ vo}
        g["pos"] = de.reshape(len(x), -1).sum(0).reshape(WINDOW, WIDTH)
        g["emb"] = np.zeros_like(p["emb"])
        pairs = np.result_type(w, np.complex64)
        np.add.at(g["emb"].ravel().view(pairs), _PAIRS.take(x.ravel(), 0).ravel(), de.ravel().view(pairs))
        return -float(np.log(np.concatenate(got)).sum()) / n, g

    def fit(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 256) -> None:
        r = np.random.default_rng(17)
        names, flat = sorted(self.p), self.flat()
        self.set_flat(flat, views=True)
        m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
        step, odd = 0, _odd(on)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                at = at[np.argsort(odd[at], kind="stable")]
                g = self.loss(x[at], y[at], on[at])[1]
                g = np.concatenate([g[k].ravel() for k in names])
                step += 1
                m1 += np.float32(0.1) * (g - m1)
                g *= g
                g -= m2
                g *= np.float32(0.01)
                m2 += g
                np.sqrt(m2 * np.float32(1 / (1 - 0.99**step)), out=g)
                g += np.float32(1e-8)
                np.divide(m1, g, out=g)
                g *= np.float32(rate / (1 - 0.9**step))
                flat -= g

    def learn(self, texts: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01) -> None:
        """Fit to all windows of texts' ids."""
        ids, off = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        at, on = self.windows(ids, off)
        self.fit(self.inputs(ids, off)[at], self.klass[ids][at], on, epochs, rate)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def set_flat(self, flat: np.ndarray, views: bool = False) -> None:
        """views: the weights share memory with flat."""
        at = 0
        for k in sorted(self.p):
            v = self.p[k]
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32, copy=not views)
            at += v.size

    def windows(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids of each window (0 where it has run out) and which of them it scores. off: texts' offsets, none empty."""
        n = np.diff(off)
        step = WINDOW - OVERLAP
        count = 1 + np.maximum(0, -(-(n - WINDOW) // step))
        of = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        at = (k * step)[:, None] + np.arange(WINDOW)
        on = (at < n[of][:, None]) & ((np.arange(WINDOW) >= OVERLAP) | (k == 0)[:, None])
        return np.where(at < n[of][:, None], at + off[of][:, None], 0), on

    def inputs(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The code of the id before each, the end's at a text's start."""
        before = np.empty(len(ids), np.int32)
        before[1:] = self.input[ids[:-1]]
        before[off[:-1]] = self.input[self.end]
        return before

    def score(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each text's ids (the end is among them)."""
        each = self.within[ids]
        x, y = self.inputs(ids, off), self.klass[ids]
        at, on = self.windows(ids, off)
        order = np.argsort(_odd(on), kind="stable")
        at, on, ready, share = at[order], on[order], self.ready(), np.empty(len(ids), np.float32)
        for lo in range(0, len(at), SOME):
            here, some = at[lo : lo + SOME], on[lo : lo + SOME]
            asks = here[some]
            share[asks] = self.shares(x.take(here), y.take(asks), some, ready)
        each += np.log10(share)
        each += (self.p["bias"] * np.log10(np.e))[y]
        return np.add.reduceat(each, off[:-1]) if len(off) > 1 else np.zeros(0)


class Words:
    """A slab's words: hashes, places, document numbers; number of words of each document."""

    def __init__(self, slab: pa.RecordBatch):
        buf, self.off = util.buffer(slab)
        self.low = util.LOWER[buf]
        self.start, self.end, self.doc = util.runs(~util.WHITE[buf], self.off)
        self.hash = util.span_hash(self.low, self.start, self.end)
        self.n = np.bincount(self.doc, minlength=slab.num_rows)

    def some(self, at: np.ndarray) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def subwords(bpe, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids on end, and where each begins (one more for the end)."""
    ids = bpe.encode_pieces([b" " + w for w in words])
    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int32), *ids]), off


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + begin[of]


def text_ids(doc: np.ndarray, n: int, index: np.ndarray, flat: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of n documents, each with the end, and the documents' offsets. doc, index: the document of each place and its word in flat."""
    size = np.diff(begin)[index] if len(index) else np.zeros(0, np.int64)
    per = np.bincount(doc, size, minlength=n).astype(np.int64) + 1
    off = np.concatenate([[0], np.cumsum(per)])
    out = np.full(off[-1], end_id, np.int32)
    body = np.ones(off[-1], bool)
    body[off[1:] - 1] = False
    out[body] = flat[_ranges(begin[index], size)] if len(index) else flat[:0]
    return out, off


def _parts(docs: DataFrame, groups: int) -> DataFrame:
    """(g, part): rows of a group as compressed Arrow streams."""
    names = ["doc_id", "text", "learn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            order = np.argsort(g, kind="stable")
            for lo, hi in zip(*_edges(g[order]), strict=True):
                sink = pa.BufferOutputStream()
                rows = t.select(names).take(pa.array(order[lo:hi]))
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as w:
                    w.write_table(rows)
                yield pa.RecordBatch.from_pydict({"g": pa.array([g[order[lo]]], pa.int32()), "part": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for b in util.pieces(batches):
            held.append(b)
            size += b.nbytes
            if size > 2 * GROUP_BYTES:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    g = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g")
    return docs.select("doc_id", "text", F.coalesce(~held_out(), F.lit(False)).alias("learn"), g).mapInArrow(run, "g int, part binary")


def _edges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return lo, np.append(lo[1:], len(sorted_values)) if len(lo) else lo


def _rows(parts) -> list[pa.RecordBatch]:
    """A group's rows in an order that does not depend on how its parts arrived."""
    batches = [b for part in sorted(parts) for b in pa.ipc.open_stream(part)]
    return list(util.pieces(iter(batches)))


def _distinct(slabs: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A group's distinct word hashes, sorted, their counts in its training documents, and the words' lengths and bytes on end; of each slab its documents' ids, which of them are known and which teach, numbers of words, and the places' words, packed."""
    hashes, counts, sizes, raw, docs, at = [], [], [], [], [], 0
    for b in slabs:
        w = Words(b)
        u, first, index = np.unique(w.hash, return_index=True, return_inverse=True)
        name, learn = b.column("doc_id"), b.column("learn").to_numpy(zero_copy_only=False)
        hashes.append(u)
        counts.append(np.bincount(index, learn[w.doc].astype(float), minlength=len(u)))
        sizes.append(w.end[first] - w.start[first])
        raw.append(w.low[_ranges(w.start[first], sizes[-1])])
        known = name.is_valid().to_numpy(zero_copy_only=False)
        docs.append((name.fill_null(0).to_numpy().astype("<i8"), known.astype("u1"), learn.astype("u1"), w.n.astype("<i4"), index + at))
        at += len(u)
    u, first, index = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    docs = [_pack(*x, index[back].astype("<i4")) for *x, back in docs]
    size = np.concatenate(sizes)
    start = np.cumsum(size) - size
    raw = np.concatenate(raw)[_ranges(start[first], size[first])]
    return u, np.bincount(index, np.concatenate(counts), minlength=len(u)).astype(np.int64), size[first].astype("<i4"), raw, docs


def _cuts(u: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(u, np.array([(b << 64) // buckets for b in range(1, buckets)], util.U64)), [len(u)]]).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [x.tobytes() for x in arrays]
    return np.array([len(x) for x in raw], "<i8").tobytes() + pa.Codec(_CODEC).compress(b"".join(raw), asbytes=True)


def _unpack(part: bytes, *kinds: str) -> list[np.ndarray]:
    at = np.concatenate([[0], np.cumsum(np.frombuffer(part[: 8 * len(kinds)], "<i8"))]).tolist()
    raw = pa.Codec(_CODEC).decompress(part[8 * len(kinds) :], at[-1], asbytes=True) if at[-1] else b""
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at[:-1], at[1:], kinds, strict=True)]


_ROW = "to int, frm int, n long, v long, part binary"
_COLUMNS = ["to", "frm", "n", "v", "part"]


def _send(buckets: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        u, c, size, raw, docs = _distinct(_rows(g["part"]))
        cut, off = _cuts(u, buckets), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = [(-1, int(key[0]), k, 0, x) for k, x in enumerate(docs)]
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if hi > lo:
                out.append((b, int(key[0]), 0, 0, _pack(u[lo:hi].astype("<u8"), c[lo:hi].astype("<i8"), size[lo:hi], raw[off[lo] : off[hi]])))
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def _answer(vocabulary: str, pattern: str):
    """Corpus counts and ids of each sender's words in the order sent; this bucket's sums of counts and of counted words, and its counts of ids."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(p, "<u8", "<i8", "<i4", "u1") for p in g["part"]]
        hashes = [x[0] for x in got]
        u, first, index = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = np.bincount(index, np.concatenate([x[1] for x in got]), minlength=len(u)).astype("<i8")
        end = np.cumsum(np.concatenate([x[2] for x in got]).astype(np.int64))
        raw = b"".join(x[3].tobytes() for x in got)
        start = end - np.concatenate([x[2] for x in got])
        flat, begin = subwords(load(vocabulary, pattern), [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        size = np.diff(begin)
        ids = np.bincount(flat, np.repeat(total, size)).astype("<i8")
        known = np.flatnonzero(ids)
        out, at = [(-1, int(key[0]), int(total.sum()), int((total > 0).sum()), _pack(known.astype("<i4"), ids[known]))], 0
        for frm, x in zip(g["frm"], hashes, strict=True):
            k = index[at : at + len(x)]
            at += len(x)
            out.append((int(frm), int(key[0]), 0, 0, _pack(total[k], size[k].astype("<i4"), flat[_ranges(begin[k], size[k])].astype("<i4"))))
        util.give_back()
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


@dataclass
class Counts:
    """What the buckets found: their answers, sums over all training documents, and how often each id stands in them (the end last)."""

    docs: DataFrame
    groups: int
    sent: DataFrame
    answers: DataFrame
    n: int
    v: int
    learnt: int
    ids: np.ndarray
    encoded: DataFrame | None = None


def _ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for p in b["part"]:
            ids, n = _unpack(p, "<i4", "<i8")
            yield pd.DataFrame({"id": ids, "n": n})


def count(docs: DataFrame, vocabulary: str, pattern: str) -> Counts:
    spark = docs.sparkSession
    util.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, learnt = docs.agg(F.sum(F.octet_length("text")), F.count_if(~held_out())).first()
    groups = util.parts_for(spark, total or 0, GROUP_BYTES)
    sent = util.materialise(_parts(docs, groups).groupBy("g").applyInPandas(_send(groups), _ROW), "words")
    answers = util.materialise(sent.where("to >= 0").groupBy("to").applyInPandas(_answer(vocabulary, pattern), _ROW), "counts")
    got = Counts(docs, groups, sent, answers, 0, 0, learnt, np.zeros(len(load(vocabulary, pattern).ranks) + 1, np.int64))
    sums = got.answers.where("to < 0")
    n, v = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    got.n, got.v = n + learnt, v + (learnt > 0)
    ids = sums.select("part").mapInPandas(_ids, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary at most
    got.ids[ids["id"].to_numpy(int)] = ids["n"].to_numpy(int)
    got.ids[-1] = learnt
    return got


_ENCODED = "doc_id long, n_tokens long, n_known long, base_score double, ids binary, g int, weight long, model binary"


def _encode(n: int, v: int, end_count: int, end_id: int, model):
    """A row for each text with its ids; with a model, a last row with the weights it has after the group's training windows, and their ids."""

    def run(key: tuple, g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        util.keep_memory()
        # Buckets are ranges of hashes, so their answers on end are in the order of the group's words.
        got = [_unpack(p, "<i8", "<i4", "<i4") for _, p in sorted(zip(answers["frm"], answers["part"], strict=True))]
        c, size, flat = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in got)]).astype(t) for k, t in enumerate((np.int64, np.int64, np.int32)))
        begin = np.concatenate([[0], np.cumsum(size)])
        log = np.log10((c + 1) / (n + v + 1))
        end = float(np.log10((end_count + 1) / (n + v + 1)))
        out, learn = [], []
        for part in g.sort_values("n")["part"]:
            name, known, teaches, m, k = _unpack(part, "<i8", "u1", "u1", "<i4", "<i4")
            m = m.astype(np.int64)
            doc = np.repeat(np.arange(len(m)), m)
            ids, off = text_ids(doc, len(m), k, flat, begin, end_id)
            each = [ids[lo:hi].astype("<i4").tobytes() for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            if model is not None:
                learn += [x for x, y in zip(each, teaches, strict=True) if y]
            out.append(pd.DataFrame({
                "doc_id": pd.arrays.IntegerArray(name.astype(np.int64), known == 0), "n_tokens": m + 1,
                "n_known": np.bincount(doc, c[k] > 0, minlength=len(m)).astype(np.int64) + (end_count > 0),
                "base_score": np.bincount(doc, log[k], minlength=len(m)) + end, "ids": each,
            }))
        got = pd.concat(out)
        got["g"], got["weight"], got["model"] = -1, 0, None
        if learn:
            # One order, however the texts arrived.
            kept = [np.frombuffer(x, "<i4") for x in sorted(learn)]
            mine = copy.copy(model.value)
            mine.p = {k: x.copy() for k, x in mine.p.items()}
            mine.learn(kept, epochs=1, rate=RATE)
            row = {"doc_id": pd.array([None], "Int64"), "n_tokens": 0, "n_known": 0, "base_score": 0.0, "ids": None, "g": int(key[0]), "weight": sum(map(len, kept)), "model": [mine.flat().astype("<f4").tobytes()]}
            got = pd.concat([got, pd.DataFrame(row)])
        util.give_back()
        return got

    return run


def _encoded(counts: Counts, end_id: int, model=None) -> DataFrame:
    run = _encode(counts.n, counts.v, counts.learnt, end_id, model)
    texts = counts.sent.where("to < 0").select(F.col("frm").alias("g"), "n", "part").groupBy("g")
    return util.materialise(texts.cogroup(counts.answers.where("to >= 0").groupBy("to")).applyInPandas(run, _ENCODED), "encoded")


def _sum(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("g")
    total = sum(np.frombuffer(m, "<f4").astype("<f8") * w for m, w in zip(g["model"], g["weight"], strict=True))
    return pd.DataFrame({"k": [int(key[0])], "weight": [int(g["weight"].sum())], "total": [total.tobytes()]})


def begin(docs: DataFrame, ids: np.ndarray, vocabulary: str, pattern: str) -> Attention:
    """A model with the corpus counts of ids, trained on the SAMPLE_DOCS training documents whose ids have the smallest hash."""
    spark = docs.sparkSession
    size = len(ids) - 1
    names = docs.select("doc_id").where(~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = F.broadcast(spark.createDataFrame(names.toPandas(), names.schema))  # at most SAMPLE_DOCS rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for b in util.pieces(batches):
            w = Words(b)
            _, first, index = np.unique(w.hash, return_index=True, return_inverse=True)
            flat, begin = subwords(bpe, w.some(first))
            ids, off = text_ids(w.doc, len(w.n), index, flat, begin, size)
            each = [ids[a : min(b, a + SAMPLE_IDS)].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(each, pa.binary())], names=["k", "ids"])

    rows = docs.join(chosen, "doc_id", "left_semi").select(F.xxhash64("doc_id", "text").alias("k"), "text").mapInArrow(cut, "k long, ids binary")
    rows = rows.groupBy("k").agg(F.first("ids").alias("ids")).orderBy("k").collect()
    kept, n = [], 0
    for r in rows:
        x = np.frombuffer(bytes(r.ids), np.int32)[: SAMPLE_IDS - n]
        if len(x):
            kept.append(x)
            n += len(x)
    model = Attention(size, ids)
    if kept:
        model.learn(kept)
    return model


def fit(docs: DataFrame, vocabulary: str, pattern: str, counts: Counts | None = None) -> Attention:
    """Trained on all training documents. counts: of the same documents, where they are wanted again for `score`."""
    counts = counts or count(docs, vocabulary, pattern)
    model = begin(counts.docs, counts.ids, vocabulary, pattern)
    if not counts.learnt:
        return model
    counts.encoded = _encoded(counts, model.end, docs.sparkSession.sparkContext.broadcast(model))
    # About as many sums as each is made of, so that neither a task nor the driver meets all groups.
    some = F.pmod("g", F.lit(max(1, round(counts.groups**0.5)))).alias("k")
    sums = counts.encoded.where("g >= 0").select("g", "weight", "model", some).groupBy("k").applyInPandas(_sum, "k int, weight long, total binary").orderBy("k").collect()
    model.set_flat(sum(np.frombuffer(bytes(r.total), "<f8") for r in sums) / sum(r.weight for r in sums))
    return model


def score(docs: DataFrame, model: Attention, vocabulary: str, pattern: str, counts: Counts | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    counts = counts or count(docs, vocabulary, pattern)
    rows = _encoded(counts, model.end) if counts.encoded is None else counts.encoded
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.keep_memory()
        for b in batches:
            each = [np.frombuffer(x, "<i4") for x in b.column("ids").to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            got = shared.value.score(np.concatenate(each), off) if each else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(got, pa.float64())], names=[*names, "score"])
        util.give_back()

    out = rows.where("g < 0").select(*names, "ids").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(counts.n).cast("long").alias("train_tokens"), "base_score", "score")
