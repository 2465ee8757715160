"""Language identification by word-first backoff.

A word seen in training is scored by its log frequency in each language; an
unseen one falls back to its character n-grams, the longest length of which any
is known. The model is fitted on a bounded sample of labelled documents: the
`per_lang` ones of each language with the smallest hash. Everything else covers
every whole text.

Defined cases: a text that is null or has no letter is `und` with score 0; so
is every text when there is nothing to learn from. A text none of whose words
and n-grams are known gets the language with most training words. Ties go to
the language that sorts first. Rows without a language, text or id are no
training rows; an id that is null is held out of nothing (its flag is null).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

#: Documents of each language in the training sample.
PER_LANG = 800
#: Parts of a language among which the sample is first looked for.
SALTS = 64
#: Bytes of text looked at at once.
SLICE = 1 << 20
#: Character n-gram lengths, tried in this order.
ORDERS = (5, 4, 3, 2, 1)

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter, as str.isalpha() has it; or a combining mark (2)."""
    global _letter
    if _letter is None:
        _letter = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            _letter[c] = 1 if kind == "L" else 2 if kind == "M" else 0
    return _letter


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts; starts, ends and text numbers of their words; whether a text has a letter."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    off = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=off[1:])
    kind = letters()[codes]
    start, end, doc = util.runs(kind > 0, off)
    any_letter = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kind == 1, out=any_letter[1:])
    real = any_letter[end] > any_letter[start]
    return codes, start[real], end[real], doc[real], any_letter[off[1:]] > any_letter[off[:-1]]


def grams(codes: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams, and which word each is of. A word of fewer characters has none."""
    count = np.maximum(end - start - n + 1, 0)
    of = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    at = np.arange(len(of)) - first[of] + start[of]
    return util.span_hash(codes, at, at + n), of


def _counts(langs: list[str]):
    schema = pa.schema([("lang", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in util.pieces(batches, cap=SLICE):
            codes, start, end, doc, _ = words(b.column("text").to_pylist())
            lang = np.array([langs.index(x) for x in b.column("lang").to_pylist()])[doc] if len(doc) else doc
            for kind, (h, of) in [(0, (util.span_hash(codes, start, end), np.arange(len(start)))), *((n, grams(codes, start, end, n)) for n in ORDERS)]:
                mine, h = lang[of].astype(np.int32), h.view(np.int64)
                order = np.lexsort((h, mine))
                mine, h = mine[order], h[order]
                at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (mine[1:] != mine[:-1]))) if len(h) else order
                yield pa.RecordBatch.from_arrays([pa.array(mine[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array(h[at]), pa.array(np.diff(np.append(at, len(h))))], schema=schema)

    return count


class Model:
    """Log frequencies by language: sorted hashes of words and n-grams (of length `kind`, 0 for words)."""

    def __init__(self, langs: list[str], table: pa.Table):
        self.langs, self.tables = langs, {}
        lang, kind, h, n = (table.column(c).to_numpy() for c in ("lang", "kind", "hash", "n"))
        self.prior = np.zeros(len(langs))
        for k in (0, *ORDERS):
            at = kind == k
            keys, where = np.unique(h[at].view(util.U64), return_inverse=True)
            c = np.zeros((len(keys), len(langs)))
            np.add.at(c, (where, lang[at]), n[at])
            total = c.sum(0)
            if k == 0:
                self.prior = total
            self.tables[k] = keys, np.log((c + 0.5) / (total + 0.5 * len(keys) + 1)).astype(np.float32)

    def look(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a table, and whether each hash is there."""
        keys, _ = self.tables[kind]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def word_scores(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        at, known = self.look(0, h)
        out = np.zeros((len(h), len(self.langs)), np.float32)
        out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(left):
                break
            g, of = grams(codes, start[left], end[left], n)
            at, known = self.look(n, g)
            hits = np.bincount(of[known], minlength=len(left))
            total = np.zeros((len(left), len(self.langs)))
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(of[known], self.tables[n][1][at[known], k], minlength=len(left))
            got = hits > 0
            out[left[got]] = total[got] / hits[got, None]
            left = left[~got]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        codes, start, end, doc, any_letter = words(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        h = util.span_hash(codes, start, end)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        each = self.word_scores(codes, start[first], end[first], u)
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(doc, each[back, k], minlength=len(texts))
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        best = np.where((total == total[:, :1]).all(1), int(np.argmax(self.prior)), np.argmax(total, 1))
        z = (total - total.max(1, keepdims=True)) / np.sqrt(n)[:, None]
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        score = p[np.arange(len(texts)), best]
        return [self.langs[b] if a else "und" for a, b in zip(any_letter, best, strict=True)], np.where(any_letter, score, 0.0)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fitted on the per_lang documents of each language with the smallest hash of their id."""
    spark = docs.sparkSession
    ok = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = ok.select("doc_id", "lang").distinct().withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    for by in (["lang", "_salt"], ["lang"]):  # the first round leaves per_lang rows of a language's every salt
        order = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang).drop("_n")
    ids = ids.drop("_salt")
    ids = ids.toArrow()
    langs = sorted(set(ids.column("lang").to_pylist()))
    if not langs:
        return Model([], pa.table({c: pa.array([], t) for c, t in (("lang", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64()), ("n", pa.int64()))}))
    chosen = F.broadcast(spark.createDataFrame(ids.to_pandas()))  # per_lang rows of each language
    sample = ok.join(chosen, ["doc_id", "lang"], "left_semi")
    rows = sample.select("lang", "text").mapInArrow(_counts(langs), "lang int, kind int, hash long, n long")
    return Model(langs, rows.groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n")).toArrow())


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score in columns called `names`, which replace columns so called; the others stay as they are."""
    util.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    rest = [k for k, c in enumerate(docs.columns) if c not in names]
    schema = T.StructType([docs.schema[k] for k in rest])
    schema = schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in util.slices(batches, at, SLICE):
            lang, score = shared.value.predict(texts)
            cols = [*(b.column(k) for k in rest), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(b.schema.names[k] for k in rest), *names])

    return docs.mapInArrow(run, schema)
