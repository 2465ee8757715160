"""Quality and toxicity from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text; where
the labels table knows a document, that is one more labeller. For each of the
two tasks expectation-maximisation over all documents' vote patterns (of which
there are at most 3 to the number of labellers) estimates how accurate each
labeller is. The posteriors of a bounded sample train a linear scorer on hashed
words and word beginnings, which then scores every whole text. Only features
whose share of good texts in the sample is SIGNAL standard errors away from the
sample's have a weight: the rest of a long text's thousands is noise. They are
counted where the texts are; the driver gets those features alone.

Defined cases: a text that is null or has no word is not kept and has quality
0 and toxicity 0. Repeated rows are scored each for itself. A null id has no
label. Labels that repeat an id count as their largest values. Without rows to
learn from the votes' majority stands in for the scorer. Where nobody votes on
one of the two tasks, every text counts as good in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Rows of the scorer's training sample: labelled ones first, those with the smallest hash.
SAMPLE = 10_000
BITS = 18
STATS = ("symbols", "capitals", "one_word", "few_words", "same_lines", "pipes", "word_length", "exclaims")
#: Texts of the sample in which a feature must be to count.
LEAST = 4
#: Standard errors from the sample's share of good texts; among 2 ** BITS features chance gives less than one.
SIGNAL = 5.0
#: Bytes of a word that its beginnings have.
HEADS = (4, 5, 6, 7)
#: The words of the two labellers of toxicity, which share none.
INSULTS = (("idiot", "moron", "pathetic", "worthless", "trash"), ("stupid", "loser", "scum", "clown", "disgusting"))
_INSULTS: list[np.ndarray] = []
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*<>{}[]=^~\\_@"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Each labeller of quality: the statistic, bad from here on. One more says good where all are as low as the last column.
QUALITY = (("symbols", 0.03, 0.005), ("capitals", 0.5, 0.15), ("one_word", 0.3, 0.12), ("few_words", 0.85, 0.6), ("same_lines", 0.4, 0.1), ("pipes", 0.01, 0.0), ("exclaims", 0.01, 0.001))


class Texts:
    """A slab's word hashes and statistics."""

    def __init__(self, slab: pa.RecordBatch):
        buf, off = util.buffer(slab)
        n = len(off) - 1
        low = util.LOWER[buf]
        start, end, doc = util.runs(_LETTER[buf], off)
        full = util.span_hash(low, start, end)
        self.words = np.bincount(doc, minlength=n)
        count = lambda at: np.diff(np.concatenate([[0], np.cumsum(at)])[off])
        size = np.maximum(np.diff(off), 1)
        letters = np.maximum(count(_LETTER[buf]), 1)
        order = np.lexsort((full, doc))
        new = np.ones(len(order), bool)
        new[1:] = (full[order[1:]] != full[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        first = np.flatnonzero(new)
        top, kinds = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(first):
            each = np.diff(np.append(first, len(order)))
            np.maximum.at(top, doc[order[first]], each)
            kinds = np.bincount(doc[order[first]], minlength=n)
        w = np.maximum(self.words, 1)
        ls, le, ld = util.runs(buf != 10, off)
        lh = util.span_hash(low, ls, le)
        lines = np.bincount(ld, minlength=n)
        pair = np.unique(np.stack([ld.astype(np.uint64), lh]), axis=1) if len(lh) else np.zeros((2, 0), np.uint64)
        lone = np.bincount(pair[0].astype(np.int64), minlength=n)
        enough = self.words >= 20
        self.stats = {
            "symbols": count(_SYMBOL[buf]) / size, "capitals": count((buf >= 65) & (buf <= 90)) / letters,
            "one_word": np.where(enough, top / w, 0), "few_words": np.where(enough, 1 - kinds / w, 0),
            "same_lines": np.where(lines >= 4, 1 - lone / np.maximum(lines, 1), 0), "pipes": count(buf == 124) / size,
            "word_length": letters / w, "exclaims": count(buf == 33) / size,
        }
        self.doc, self.full = doc, full
        self.heads = [util.span_hash(low, start, np.minimum(end, start + k)) for k in HEADS]
        if not _INSULTS:
            for words in INSULTS:
                raw = np.frombuffer("".join(words).encode(), np.uint8)
                edge = np.concatenate([[0], np.cumsum([len(x) for x in words])])
                _INSULTS.append(util.span_hash(raw, edge[:-1], edge[1:]))
        self.insults = [np.bincount(doc[np.isin(full, h)], minlength=n) for h in _INSULTS]

    def votes(self) -> tuple[list[str], list[str]]:
        """A character for each labeller: + good, - bad, 0 nothing. For toxicity, - is toxic."""
        cols = [np.where(self.stats[s] >= bad, "-", "0") for s, bad, _ in QUALITY]
        cols.append(np.where(np.all([self.stats[s] <= good for s, _, good in QUALITY], 0), "+", "0"))
        n = len(self.words)
        tox = [np.where(k > 0, "-", "0") for k in self.insults]
        return ["".join(c[i] for c in cols) for i in range(n)], ["".join(c[i] for c in tox) for i in range(n)]

    def _keys(self, use: np.ndarray | None = None) -> np.ndarray:
        """Text number and feature of each text's distinct hashed features: words, word beginnings, and each statistic's tenth. use: which features count, all if None."""
        mask = util.U64((1 << BITS) - 1)
        n = len(self.words)
        part = [(self.doc, (util.mix(h ^ util.U64(k + 1)) & mask).astype(np.int64)) for k, h in enumerate((self.full, *self.heads))]
        for k, s in enumerate(STATS):
            level = np.clip(np.sqrt(np.maximum(self.stats[s], 0)) * 10, 0, 40).astype(np.int64)
            part.append((np.arange(n), (util.mix((level + 100 * k + 7_000_000).astype(util.U64)) & mask).astype(np.int64)))
        if use is not None:
            part = [(d[at], f[at]) for d, f, at in ((d, f, use[f]) for d, f in part)]
        return np.unique(np.concatenate([(d << BITS) | f for d, f in part]))

    def features(self) -> list[np.ndarray]:
        n, key = len(self.words), self._keys()
        return np.split(key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(1, n) << BITS)) if n else []

    def scores(self, *scorers: Scorer) -> list[np.ndarray]:
        """Each scorer's probabilities of the texts; only features with a weight are sorted."""
        key = self._keys(np.any([s.w != 0 for s in scorers], 0))
        doc, f = key >> BITS, key & ((1 << BITS) - 1)
        return [s.squash(np.bincount(doc, weights=s.w[f], minlength=len(self.words)) + s.b) for s in scorers]


@dataclass
class LabelModel:
    """Share of good documents and, for each labeller, how it votes (+, 0, -) on good and on bad ones."""

    prior: float
    table: np.ndarray  # labeller, class (good, bad), vote

    def posterior(self, pattern: str) -> float:
        k = [i for i, c in enumerate(pattern) if c != "0"]  # who says nothing is no evidence
        v = ["+0-".index(pattern[i]) for i in k]
        good = np.log(self.prior) + np.log(self.table[k, 0, v]).sum()
        bad = np.log(1 - self.prior) + np.log(self.table[k, 1, v]).sum()
        return float(1 / (1 + np.exp(np.clip(bad - good, -50, 50))))

    def accuracy(self) -> np.ndarray:
        """Share of right votes among those cast, on a balance of the classes as estimated."""
        g, b = self.table[:, 0] * self.prior, self.table[:, 1] * (1 - self.prior)
        return (g[:, 0] + b[:, 2]) / (g[:, 0] + g[:, 2] + b[:, 0] + b[:, 2])


def expectation_maximisation(patterns: dict[str, int], rounds: int = 15) -> LabelModel:
    """From counts of vote patterns, those without a vote left out. Starts from majority votes, so that + means good."""
    names = sorted(p for p in patterns if p.strip("0"))
    if not names:
        return LabelModel(0.5, np.full((len(next(iter(patterns), "")), 2, 3), 1 / 3))
    count = np.array([patterns[p] for p in names], float)
    v = np.array([["+0-".index(c) for c in p] for p in names])
    one = np.eye(3)[v]  # pattern, labeller, vote
    cast = (v == 0).sum(1) - 1.5 * (v == 2).sum(1)
    good = 1 / (1 + np.exp(-4 * cast))
    model = None
    for _ in range(rounds):
        prior = float(np.clip((count @ good) / count.sum(), 0.01, 0.99))
        table = np.stack([np.einsum("p,pkv->kv", count * w, one) + np.array([0.5, 0.5, 0.5]) for w in (good, 1 - good)], 1)
        model = LabelModel(prior, table / table.sum(2, keepdims=True))
        good = np.array([model.posterior(p) for p in names])
    return model


class Scorer:
    """Logistic regression on binary hashed features, by AdaGrad."""

    def __init__(self) -> None:
        self.w, self.b = np.zeros(1 << BITS, np.float32), 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.1) -> None:
        if not len(rows):
            self.b = 2.0  # nobody objects
            return
        r = np.random.default_rng(9)
        sq = np.full(1 << BITS, 1e-6)
        bsq = 1e-6
        for _ in range(epochs):
            for i in r.permutation(len(rows)):
                f = rows[i]
                p = float(self.squash(self.w[f].sum() + self.b))
                g = p - y[i]
                sq[f] += g * g
                bsq += g * g
                self.w[f] -= (rate * g / np.sqrt(sq[f])).astype(np.float32)
                self.b -= rate * g / np.sqrt(bsq)

    def squash(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(n: np.ndarray, good: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features tell good texts from bad ones: n texts of the sample have each, `good` is the sum of their posteriors, y are all posteriors."""
    if not len(y):
        return np.zeros(len(n), bool)
    p = y.mean()
    return (n >= LEAST) & (np.abs(good - n * p) >= SIGNAL * np.sqrt(n * p * (1 - p))) & (0 < p < 1)


@dataclass
class Model:
    quality: Scorer
    toxic: Scorer
    labellers: tuple[LabelModel, LabelModel] | None


def _voted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, q and t (vote patterns, the label's vote last), known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in util.pieces(batches):
            x = Texts(b)
            q, t = x.votes()
            some = pa.array(x.words > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(some), pa.array(q, pa.string()).filter(some), pa.array(t, pa.string()).filter(some)], names=["doc_id", "q", "t"])

    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    vote = lambda c, good: F.when(F.col(c).isNull(), "0").when(F.col(c) == good, "+").otherwise("-")
    kind = dict(docs.dtypes)["doc_id"]
    votes = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, q string, t string").join(known, "doc_id", "left")
    return votes.select("doc_id", F.concat("q", vote("quality", 1)).alias("q"), F.concat("t", vote("toxic", 0)).alias("t"), (F.col("quality").isNotNull() | F.col("toxic").isNotNull()).alias("known"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    util.small_batches(spark)
    votes = util.materialise(_voted(docs, labels), "votes")
    seen = votes.groupBy("q", "t").count().collect()  # at most 3 ** labellers rows
    if not seen:
        return Model(Scorer(), Scorer(), None)
    counts: tuple[dict, dict] = {}, {}
    for r in seen:
        for k, p in enumerate((r.q, r.t)):
            counts[k][p] = counts[k].get(p, 0) + r["count"]
    label = tuple(expectation_maximisation(c) for c in counts)
    some = votes.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.desc("known"), F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    some = some.select("doc_id", "q", "t").toPandas()
    for k, c in enumerate(("q", "t")):  # the posterior, or no number where nobody votes
        some[c] = np.array([label[k].posterior(p) if p.strip("0") else np.nan for p in some[c]], float)
    kind = dict(docs.dtypes)["doc_id"]
    chosen = F.broadcast(spark.createDataFrame(some, f"doc_id {kind}, q double, t double"))  # at most SAMPLE rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(_features, f"doc_id {kind}, q double, t double, f array<int>")
    rows = util.materialise(rows.dropDuplicates(["doc_id"]), "features")
    sums = rows.mapInArrow(_sums, "f int, nq double, gq double, nt double, gt double").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("nq", "gq", "nt", "gt"))).toPandas()  # at most 2 ** BITS rows
    posterior = [some[c].to_numpy()[~np.isnan(some[c].to_numpy())] for c in ("q", "t")]
    use = []
    for c, y in zip(("q", "t"), posterior, strict=True):
        of = np.zeros(1 << BITS, bool)
        of[sums["f"].to_numpy()] = telling(sums[f"n{c}"].to_numpy(), sums[f"g{c}"].to_numpy(), y)
        use.append(of)
    shared = spark.sparkContext.broadcast(use[0] | use[1])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("f")
            flat, off = f.flatten().to_numpy(), f.offsets.to_numpy() - f.offsets[0].as_py()
            at = shared.value[flat]
            edge = np.concatenate([[0], np.cumsum(at)])[off].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "q", "t")), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat[at]))], names=["doc_id", "q", "t", "f"])

    got = rows.mapInArrow(told, rows.schema).toPandas().sort_values("doc_id")
    f = [np.asarray(x, np.int64) for x in got["f"]]
    out = []
    for k, c in enumerate(("q", "t")):
        s, y = Scorer(), got[c].to_numpy()
        voted = np.flatnonzero(~np.isnan(y))
        s.fit([f[i][use[k][f[i]]] for i in voted], y[voted])
        out.append(s)
    return Model(*out, label)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in util.pieces(batches):
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "q", "t")), pa.array([f.astype(np.int32) for f in Texts(b).features()], pa.list_(pa.int32()))], names=["doc_id", "q", "t", "f"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature of a task's rows, how many rows with a posterior have it and the sum of those; for both tasks."""
    all_ = np.zeros((4, 1 << BITS))
    for b in batches:
        f = b.column("f")
        flat, each = f.flatten().to_numpy(), np.diff(f.offsets.to_numpy())
        for k, c in enumerate(("q", "t")):
            y = np.repeat(b.column(c).to_numpy(zero_copy_only=False).astype(float), each)
            some = ~np.isnan(y)
            all_[2 * k] += np.bincount(flat[some], minlength=1 << BITS)
            all_[2 * k + 1] += np.bincount(flat[some], weights=y[some], minlength=1 << BITS)
    at = np.flatnonzero(all_[0] + all_[2])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(a[at]) for a in all_)], names=["f", "nq", "gq", "nt", "gt"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality_prob, toxic_prob, keep of each row."""
    util.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in util.pieces(batches):
            x = Texts(b)
            some = x.words > 0
            if m.labellers is None:
                q, t = (np.array([float(v.count("+") >= v.count("-")) for v in vs]) for vs in x.votes())
            else:
                q, t = x.scores(m.quality, m.toxic)
            q, t = np.where(some, q, 0.0), np.where(some, 1 - t, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q), pa.array(t), pa.array(some & (q >= 0.5) & (t < 0.5))], names=["doc_id", "quality_prob", "toxic_prob", "keep"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, quality_prob double, toxic_prob double, keep boolean")
