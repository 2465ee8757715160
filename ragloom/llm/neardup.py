"""Near-duplicate documents: SetSketch registers, banded, estimated, then verified on full sets.

A document's set is that of its distinct shingles of `words` words; with fewer
words, the whole sequence is its only shingle. Documents of one and the same set
form a class, of which only one representative goes on.

A set's sketch: each element starts a Poisson process of rate m whose points
fall on m registers, so that a register's first point is exponential; the
registers keep the minima over all elements, as integers on an exponentially
spaced scale, truncated at both ends. Processes stop as soon as they can change
no register any more. Sketches of sets merge register by register.

Bands of registers are join keys. In each band's bucket the smallest
representative is compared with the others; verified links give components, and
only buckets that still hold several components are looked at again, for pairs
of different components. There the members of all but a bucket's largest
component meet all others, a pair of bounded blocks at a time; a block pair
compares in place: a pair is looked at in the first band that it shares, its
joint likelihood estimate must leave the threshold possible, and then the full
sets are compared. A block pair gives at most a spanning set of links, never
its pairs. Links skipped are those within a component already found, so that
components are those of all links between documents that share a band.

With the defaults a pair of similarity 0.8 shares no band with probability
(1 - 0.8^4)^32 = 5e-8.

Defined cases: texts that are null or hold no words have an empty set, are
linked with nothing and are kept. Rows of equal text or set are linked. A null
id takes no part: its row has its n_shingles, no component, and is kept. Rows
that repeat an id are one document for the components, which keep the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util
from .components import components

#: Registers of a sketch, and how many of them make a band.
REGISTERS, BAND = 128, 4
#: Base of the registers' scale and their largest value (they are unsigned 16-bit integers).
BASE, TOP = 1.001, 65535
#: What is added to a register before truncation: scale values below zero would be minima over 2^13 or so.
SHIFT = 32768
#: Estimates this far below the threshold are ruled out: over five standard deviations for 128 registers.
MARGIN = 0.2
#: Members of a block, and the shingles that it holds on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    h, doc = util.word_hashes(buf, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    mult = util.mix(np.arange(1, words + 1, dtype=util.U64))
    s = np.zeros(len(h), util.U64)
    for k in range(words):
        s[: len(h) - k] += h[k:] * (mult[k] | util.U64(1))
    s = util.mix(s + util.U64(words))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            k = b - a
            out.append(util.mix(np.sum(h[a:b] * (mult[:k] | util.U64(1)), keepdims=True, dtype=util.U64) + util.U64(k)))
        else:
            out.append(np.zeros(0, util.U64))
    return out


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of registers for each set (not empty)."""
    size = np.array([len(s) for s in sets])
    low = np.full(len(sets) * m, np.inf)
    seed = np.concatenate(sets) if sets else np.zeros(0, util.U64)
    row = np.repeat(np.arange(len(sets)), size)
    t = np.zeros(len(seed))
    k = 0
    while len(seed):
        k += 1
        x = util.mix(seed + util.U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        t -= np.log(((x >> util.U64(11)).astype(np.float64) + 1) / 2**53) / m
        reg = (util.mix(x) % util.U64(m)).astype(np.int64)
        np.minimum.at(low, row * m + reg, t)
        worst = low.reshape(-1, m).max(1)
        on = t < worst[row]
        seed, row, t = seed[on], row[on], t[on]
    k = np.floor(SHIFT + 1 - np.log(low) / np.log(BASE))
    return np.clip(k, 0, TOP).astype("<u2").reshape(-1, m)


def _likelihood(j, up: np.ndarray, down: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Joint log likelihood of similarity j for sets of which the first has the share u of both sizes. It is concave in j."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    one, two = p(u - (1 - u) * j), p(1 - u - u * j)
    return up * np.log(one) + down * np.log(two) + same * np.log(np.clip(1 - one - two, 1e-9, 1))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketched sets of known sizes: the joint likelihood's maximum on a grid of hundredths."""
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same, u = a.shape[-1] - up - down, na / (na + nb)
    best, out = np.full(u.shape, -np.inf), np.zeros(u.shape)
    for j in np.arange(0, 1.0001, 0.01):
        value = np.where(j <= np.minimum(na, nb) / np.maximum(na, nb) + 0.01, _likelihood(j, up, down, same, u), -np.inf)
        out = np.where(value > best, j, out)
        best = np.maximum(best, value)
    return out


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is at least `least`: the likelihood, being concave, still rises towards it."""
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same, u = a.shape[-1] - up - down, na / (na + nb)
    return _likelihood(least, up, down, same, u) >= _likelihood(least - 0.01, up, down, same, u)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sketched sets."""
    return np.maximum(a, b)


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits that tell sets apart), regs."""
    util.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in util.pieces(batches):
            sets = shingles(*util.buffer(b), words)
            regs = sketch(sets)
            full = [len(s) > 0 for s in sets]
            total = lambda k: pa.array([int(util.mix(s ^ util.U64(k)).sum(dtype=util.U64).view(np.int64)) for s in sets], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), total(0x51ED), total(0xC0FFEE), pa.array([r.tobytes() if f else None for r, f in zip(regs, full, strict=True)], pa.binary())],
                names=["doc_id", "n", "s1", "s2", "regs"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary")


def _banded(reps: DataFrame) -> DataFrame:
    """(bucket, band, rep, n): a row for each band of each representative."""
    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    return reps.select("rep", "n", F.posexplode(bands).alias("band", "bucket"))


def _possible(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs of sketched sets may reach the threshold."""
    ok = np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num
    # Equal registers alone rule most pairs out: the estimate is not far above their share.
    at = np.flatnonzero(ok)
    ok[at] = (x[at] == y[at]).mean(1) >= num / den - 1.8 * MARGIN
    at = np.flatnonzero(ok)
    ok[at] = reaches(x[at], y[at], nx[at].astype(float), ny[at].astype(float), num / den - MARGIN)
    return ok


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _estimated(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                p = b.slice(lo, 4096)
                ok = pa.array(_near(_regs(p.column("ra")), _regs(p.column("rb")), p.column("na").to_numpy(), p.column("nb").to_numpy(), num, den))
                yield pa.RecordBatch.from_arrays([p.column("a").filter(ok), p.column("b").filter(ok)], names=["a", "b"])

    one, two = (reps.select(F.col("rep").alias(c), F.col("n").alias("n" + c), F.col("regs").alias("r" + c)) for c in "ab")
    return pairs.join(one, "a").where("a <> b").join(two, "b").where(_possible("na", "nb", num, den)).mapInArrow(run, "a long, b long").distinct()


def shared_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Intersection sizes of the sets numbered left with those numbered right, as products of incidence matrices, some shingles at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    mine = np.full(len(sets), -1)
    mine[left] = np.arange(len(left))
    theirs = np.full(len(sets), -1)
    theirs[right] = np.arange(len(right))
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[number] > 1  # a shingle of one set alone is in no intersection
    of, number = of[common], np.unique(number[common], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    of, number = of[order], number[order]
    top = int(number[-1]) + 1 if len(number) else 0
    for lo in range(0, top, columns):
        a, b = np.searchsorted(number, [lo, lo + columns])
        width = min(columns, top - lo)
        parts = []
        for place, size in ((mine, len(left)), (theirs, len(right))):
            m = np.zeros((size, width), np.float32)
            at = np.flatnonzero(place[of[a:b]] >= 0) + a
            m[place[of[at]], number[at] - lo] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _spanning(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Of the links between i and j, in order, those that join components that the ones before do not."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for k, (a, b) in enumerate(zip(comp[i].tolist(), comp[j].tolist(), strict=True)):
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _links(block: pa.Table, words: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the members of two blocks (of one, if x = y) of one bucket whose components differ.

    block: x and y (the same in all rows), at (a member's own block: x or y), band (null: pairs are looked at whatever
    their first band), rep, n, component, regs, text.
    """
    x, y = block.column("x")[0].as_py(), block.column("y")[0].as_py()
    rep, n, comp, at = (block.column(c).to_numpy() for c in ("rep", "n", "component", "at"))
    band = block.column("band").fill_null(-1).to_numpy()
    regs = _regs(block.column("regs").combine_chunks())
    one, two = np.flatnonzero(at == x), np.flatnonzero(at == y)
    many = max(1, 8192 // max(len(two), 1))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(one), many):
        some = one[lo : lo + many]
        i, j = np.repeat(some, len(two)), np.tile(two, len(some))
        on = comp[i] != comp[j]
        if x == y:
            on &= i < j
        i, j = i[on], j[on]
        ok = _near(regs[i], regs[j], n[i], n[j], num, den)
        i, j = i[ok], j[ok]
        first = (regs[i] == regs[j]).reshape(len(i), regs.shape[1] // BAND, BAND).all(2).argmax(1)
        ok = (band[i] < 0) | (first == band[i])
        left.append(i[ok])
        right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return i, j
    who, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    sets = shingles(*util.buffer(pa.RecordBatch.from_arrays([block.column("text").take(pa.array(who)).combine_chunks()], names=["text"])), words)
    a, b = place[: len(i)], place[len(i) :]
    rows, cols = np.unique(a), np.unique(b)
    both = shared_sizes(sets, rows, cols)[np.searchsorted(rows, a), np.searchsorted(cols, b)]
    size = np.array([len(s) for s in sets])
    ok = np.flatnonzero(den * both >= num * (size[a] + size[b] - both))
    keep = ok[_spanning(comp, i[ok], j[ok])]
    return rep[i[keep]], rep[j[keep]]


def compare(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links found in the block pairs (key, x, y) of members, which are as _links takes them."""
    key = ["key", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            a, b = _links(pa.Table.from_batches(held), words, num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in key], 1)
            edge = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if held and tuple(k[lo]) != last:
                    yield from out()
                    held = []
                last = tuple(k[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from out()
        util.give_back()

    return members.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _blocks(count, size):
    """Blocks for so many members with so many shingles in all."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _star_members(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) as blocks: each a with its partners, dealt into as many as their number asks for, so that a's text travels once for each."""
    sized = pairs.join(reps.groupBy(F.col("rep").alias("b")).agg(F.max("n").alias("_n")), "b")
    size = sized.groupBy("a").agg(_blocks(F.count("*"), F.sum("_n")).alias("blocks"))
    deal = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int") + 1
    partners = pairs.join(size, "a").select(F.col("a").alias("key"), F.lit(0).alias("x"), deal.alias("y"), deal.alias("at"), F.col("b").alias("rep"))
    leaders = size.select(F.col("a").alias("key"), F.lit(0).alias("x"), F.explode(F.sequence(F.lit(1), "blocks")).alias("y"), F.lit(0).alias("at"), F.col("a").alias("rep"))
    rows = partners.unionByName(leaders).withColumn("band", F.lit(None).cast("int")).withColumn("component", F.col("rep"))
    return rows.join(reps.select("rep", "n", "regs"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")


def _split_members(named: DataFrame) -> DataFrame:
    """The block pairs of buckets that hold several components, without sketches and texts.

    The largest component's members are in blocks of their own, numbered below zero; each of the others' blocks meets
    these and each other, itself included.
    named: bucket, band, rep, n, component.
    """
    each = named.groupBy("bucket", "component").agg(F.count("*").alias("_n"), F.sum("n").alias("_s"))
    top = F.max(F.struct("_n", "component", "_s"))
    split = each.groupBy("bucket").agg(top.alias("_t"), F.count("*").alias("_c"), F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).where("_c > 1")
    t = F.col("_t")
    split = split.select("bucket", t["component"].alias("_big"), _blocks(t["_n"], t["_s"]).alias("_l"), _blocks(F.col("_n") - t["_n"], F.col("_s") - t["_s"]).alias("_k"))
    big = F.col("component") == F.col("_big")
    at = F.when(big, -1 - F.pmod(F.xxhash64("rep"), F.col("_l"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("_k"))).cast("int")
    to = F.when(big, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(F.sequence(-F.col("_l"), F.col("_k") - 1))
    rows = named.join(split, "bucket").withColumn("at", at).select("*", F.explode(to).alias("_o"))
    small, large = F.least("at", "_o"), F.greatest("at", "_o")
    return rows.select(F.col("bucket").alias("key"), large.alias("x"), small.alias("y"), "at", "band", "rep", "n", "component")


def _same_id(real: DataFrame, reps: DataFrame) -> DataFrame:
    """Links that make the rows of a repeated id one document, whatever their texts."""
    several = real.groupBy("doc_id").agg(F.min("s1").alias("_l"), F.max("s1").alias("_h")).where("_l <> _h").select("doc_id")
    return real.join(several, "doc_id").join(reps.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; links have den * intersection >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = util.materialise(features(docs, words), "features")
    real = feats.where("n > 0 and doc_id is not null")
    reps = util.materialise(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "classes")
    banded = util.materialise(_banded(reps), "bands")
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).where("leader < _last").drop("_last")
    buckets = util.materialise(banded.join(shared, "bucket"), "buckets")

    def texts(some: DataFrame) -> DataFrame:
        """Texts of the documents in some; these are written first, so that Spark knows how few they are."""
        some = util.materialise(some.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        return util.materialise(docs.join(some, "doc_id", "left_semi").distinct(), "texts")

    stars = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    tried = util.materialise(_estimated(stars, reps, num, den), "pairs")
    both = tried.select(F.col("a").alias("rep")).unionByName(tried.select(F.col("b").alias("rep")))
    links = util.materialise(compare(_star_members(tried, reps, texts(both)), words, num, den), "links")
    comp = util.materialise(components(links, "a", "b"), "components")

    # A bucket's leader has met the others; pairs of these are left where they are not yet of one component.
    others = buckets.where("rep <> leader").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    left = util.materialise(_split_members(others), "members")
    if not left.isEmpty():
        members = left.join(reps.select("rep", "regs", F.col("n").alias("_n")), "rep").where("n = _n").drop("_n")
        members = members.join(texts(left).withColumnRenamed("doc_id", "rep"), "rep")
        links = links.unionByName(util.materialise(compare(members, words, num, den), "links"))
    links = links.unionByName(_same_id(real, reps))

    comp = util.materialise(components(links, "a", "b"), "components")
    classes = reps.select("s1", "s2", "n", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("s1", "s2", "n", F.coalesce("component", "rep").alias("_component"))
    out = feats.drop("regs").join(classes, ["s1", "s2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
