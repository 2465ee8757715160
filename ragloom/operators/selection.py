"""From fused candidates to the few that answer: near-copies out, then a selection that spreads over sections and files.

The order-dependent parts run as grouped maps on one question's candidates,
which fusion has bounded (two lists of at most 100). Everything is totally
ordered: equal scores go to the smaller chunk id.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SELECTION_STOP, Grams, shared_trigrams, trigram_codes, trigram_table

SECTION_CAP = 5


def grams(text: str) -> frozenset[str]:
    t = re.sub(r"\s+", " ", text.lower(), flags=re.ASCII)
    return frozenset(t[i : i + 3] for i in range(len(t) - 2))


def similar(a: frozenset, b: frozenset) -> float:
    if not a or not b:
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def drop_near_copies(candidates: DataFrame, least: float = 0.85, query_id: str = "query_id") -> DataFrame:
    """In rank order and for each file, what is more alike than `least` to one already kept goes.

    candidates: query_id, file_name, rank, text and any more columns.
    """
    schema = candidates.schema

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kept, rows = [], []
        for i, t in zip(g.sort_values("rank").index, g.sort_values("rank")["text"], strict=True):
            own = grams(t or "")
            if all(similar(own, k) <= least for k in kept):
                kept.append(own)
                rows.append(i)
        return g.loc[rows]

    return candidates.groupBy(query_id, "file_name").applyInPandas(run, schema)


def keywords(question: str) -> tuple[list[str], list[str]]:
    """A question's telling words and pairs of neighbours."""
    w = [x for x in re.sub(r"[^a-z0-9\s-]", "", question.lower(), flags=re.ASCII).split() if len(x) >= 3 and x not in SELECTION_STOP]
    return list(dict.fromkeys(w)), list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def zones(rows: list[dict], n: int) -> list[dict]:
    """n of a file's candidates spread over its length: a fifth from the first third, three tenths from the next, the rest."""
    if len(rows) <= n:
        return sorted(rows, key=_by_score)
    rows = sorted(rows, key=lambda r: (r["chunk_index"], r["chunk_id"]))
    third = max(1, len(rows) // 3)
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    want = [int(n * 0.2), int(n * 0.3)]
    want.append(n - sum(want))
    out = [r for p, w in zip(parts, want, strict=True) for r in sorted(p, key=_by_score)[:w]]
    taken = {r["chunk_id"] for r in out}
    return (out + sorted((r for r in rows if r["chunk_id"] not in taken), key=_by_score)[: n - len(out)])[:n]


def _by_score(r: dict) -> tuple:
    return -r["score"], r["chunk_id"]


class Selection:
    """One question's selection: what has been taken, and how often each section."""

    def __init__(self, rows: list[dict], limit: int, question: str, parts: list[str], is_list: bool):
        self.rows, self.limit, self.parts, self.is_list = rows, limit, parts, is_list
        self.words, self.pairs = keywords(question)
        self.taken: list[dict] = []
        self.sections: dict[str, int] = {}

    def left(self) -> int:
        return self.limit - len(self.taken)

    def admit(self, r: dict) -> bool:
        key = (r["section_header"] or "")[:60] or "__none__"
        if self.sections.get(key, 0) >= SECTION_CAP or any(t["chunk_id"] == r["chunk_id"] for t in self.taken):
            return False
        self.sections[key] = self.sections.get(key, 0) + 1
        self.taken.append(r)
        return True

    def classify(self) -> tuple[list[dict], list[dict], list[dict]]:
        phrase, keyed, rest = [], [], []
        for r in self.rows:
            low = r["text"].lower()
            r["found"] = {w for w in self.words if w in low}
            if any(p in low for p in self.pairs):
                phrase.append(r)
            elif r["found"]:
                keyed.append(r)
            else:
                rest.append(r)
        return phrase, keyed, rest

    def cover_parts(self, keyed: list[dict]) -> None:
        """Each part of the question gets a chunk with one of its words, at the cost of the weakest keyword pick."""
        need = [set(keywords(p)[0]) for p in self.parts]
        has = lambda r, words: any(w in r["text"].lower() for w in words)
        for words in need:
            if not words or any(has(r, words) for r in self.taken):
                continue
            held = {r["chunk_id"] for r in self.taken}
            found = sorted((r for r in self.rows if r["chunk_id"] not in held and has(r, words)), key=_by_score)
            if not found:
                continue
            if self.left() <= 0:
                ids = {r["chunk_id"] for r in keyed}
                weak = sorted((r for r in self.taken if r["chunk_id"] in ids), key=lambda r: (r["rare"], r["score"], -r["chunk_id"]))
                weak = [r for r in weak if all(not w or not has(r, w) or any(has(t, w) for t in self.taken if t is not r) for w in need)]
                if not weak:
                    continue
                self.taken.remove(weak[0])
            self.taken.append(found[0])

    def run(self) -> list[dict]:
        rows, limit = self.rows, self.limit
        if len(rows) <= limit:
            return rows
        everything = rows
        self.rows = rows = [r for r in rows if not r["is_toc"]]
        phrase, keyed, rest = self.classify()
        cap = max(2, limit // 4) if self.is_list else max(4, limit // 2)
        for n, r in enumerate(phrase):
            if n >= cap or self.left() <= 0 or not self.admit(r):
                rest.append(r)
        common = {w: sum(w in r["text"].lower() for r in everything) for w in self.words}
        few = max(10, len(everything) // 10)
        for r in rows:
            r["rare"] = sum(common[w] <= few for w in r["found"])
        keyed.sort(key=lambda r: (-r["rare"], -r["score"], -len(r["found"]), r["chunk_id"]))
        greedy = max(4, limit // 2) if self.is_list else limit
        later = [r for r in keyed if len(self.taken) >= greedy or not self.admit(r)]
        if len(self.parts) > 1:
            self.cover_parts(keyed)
        hit_files = {r["file_name"] for r in phrase} | {r["file_name"] for r in self.taken}
        if self.left() > 0:
            self.fill(rest, later, hit_files)
        return self.taken[:limit]

    def fill(self, rest: list[dict], later: list[dict], hit_files: set[str]) -> None:
        files: dict[str, list[dict]] = {}
        for r in rest:
            files.setdefault(r["file_name"], []).append(r)
        mean = {f: sum(r["score"] for r in rs) / len(rs) for f, rs in files.items()}
        order = sorted(files, key=lambda f: (f not in hit_files, -mean[f], f))
        want = min(len(later), (self.left() + 1) // 2)
        if self.is_list:
            by: dict[str, list[dict]] = {}
            for r in sorted(later, key=_by_score):
                by.setdefault(r["section_header"] or "", []).append(r)
            turns = [(n, *_by_score(rs[0]), r) for rs in by.values() for n, r in enumerate(rs)]
            later = [t[-1] for t in sorted(turns, key=lambda t: t[:3])]
        else:
            later = sorted(later, key=_by_score)
        for r in later:
            if want <= 0 or self.left() <= 0:
                break
            want -= self.admit(r)
        if not order or self.left() <= 0:
            return
        middle = sorted(mean.values())[len(mean) // 2]
        first = [f for f in order if f in hit_files or mean[f] >= middle] or order
        picked: set = set()
        for i, f in enumerate(first):
            share = max(2, math.ceil(self.left() / (len(first) - i)))
            for r in zones(files[f], min(share, max(self.left(), 0))):
                picked.add(r["chunk_id"])
                if self.left() > 0:
                    self.admit(r)
        while self.left() > 0:
            before = len(self.taken)
            for f in order:
                free = [r for r in sorted(files[f], key=_by_score) if r["chunk_id"] not in picked]
                if free and self.left() > 0:
                    picked.add(free[0]["chunk_id"])
                    self.admit(free[0])
            if len(self.taken) == before:
                return


def select_diverse(candidates: DataFrame, limit: int = 20, query_id: str = "query_id") -> DataFrame:
    """query_id, pick (from 1), chunk_id, score: at most `limit` of each question's candidates.

    candidates: query_id, question, parts, is_list, rank, chunk_id, file_name, chunk_index, section_header, text, is_toc, score.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank", "chunk_id"]).drop_duplicates("chunk_id")
        rows = g.assign(text=g["text"].fillna("")).to_dict("records")
        got = Selection(rows, limit, g["question"].iloc[0] or "", list(g["parts"].iloc[0]), bool(g["is_list"].iloc[0])).run()
        return pd.DataFrame({query_id: key[0], "pick": range(1, len(got) + 1), "chunk_id": [r["chunk_id"] for r in got], "score": [float(r["score"]) for r in got]})

    return candidates.groupBy(query_id).applyInPandas(run, f"{query_id} long, pick long, chunk_id long, score double")


def section_cap(df: DataFrame, cap: int = SECTION_CAP, query_id: str = "query_id") -> DataFrame:
    """The first `cap` of each section by rank, in one pass."""
    key = F.coalesce(F.nullif(F.substring("section_header", 1, 60), F.lit("")), F.lit("__none__"))
    w = Window.partitionBy(query_id, key).orderBy("rank")
    return df.withColumn("in_section", F.row_number().over(w).cast("long")).where(F.col("in_section") <= cap)


def round_robin(df: DataFrame, group: str, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """position: one of each group in turn, groups by their best score."""
    w = Window.partitionBy(query_id, group)
    t = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), chunk_id))).withColumn("_m", F.max("score").over(w))
    return t.withColumn("position", F.row_number().over(Window.partitionBy(query_id).orderBy("_n", F.desc("_m"), group, chunk_id)).cast("long")).drop("_n", "_m")


def zone_pick(df: DataFrame, n: int, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """zone (0, 1, 2) and place_in_zone of each candidate of a file; picked: within its zone's share of n."""
    w = Window.partitionBy(query_id, "file_name")
    t = df.withColumn("_i", F.row_number().over(w.orderBy("chunk_index", chunk_id)) - 1).withColumn("_t", F.count("*").over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("_t") / 3))
    t = t.withColumn("zone", F.least(F.lit(2), F.floor(F.col("_i") / third)).cast("long"))
    t = t.withColumn("place_in_zone", F.row_number().over(Window.partitionBy(query_id, "file_name", "zone").orderBy(F.desc("score"), chunk_id)).cast("long"))
    share = F.when(F.col("zone") == 0, int(n * 0.2)).when(F.col("zone") == 1, int(n * 0.3)).otherwise(n - int(n * 0.2) - int(n * 0.3))
    return t.withColumn("picked", (F.col("_t") <= n) | (F.col("place_in_zone") <= share)).drop("_i", "_t")


def file_rank(df: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, file_name, avg_score, has_hit, file_rank, priority: files with keyword hits first, then by mean score."""
    f = df.groupBy(query_id, "file_name").agg(F.avg("score").alias("avg_score"), F.max("has_hit").alias("has_hit"))
    w = Window.partitionBy(query_id)
    f = f.withColumn("file_rank", F.row_number().over(w.orderBy(F.desc("has_hit"), F.desc("avg_score"), "file_name")).cast("long"))
    sorted_means = F.array_sort(F.collect_list("avg_score").over(w))
    middle = F.element_at(sorted_means, (F.floor(F.size(sorted_means) / 2) + 1).cast("int"))
    return f.withColumn("priority", F.col("has_hit") | (F.col("avg_score") >= middle))


def numbered(rows: DataFrame, group: str, key: str, tie: str, each: int = 4096, parts: int = 256) -> DataFrame:
    """Adds n, a row's place from 0 in its group by a whole-numbered key. A large group is dealt out by stretches of the key, about `each` rows long or so many in all."""
    parts = max(1, min(parts, rows.count() // each))
    cuts = sorted({int(x) for x in rows.approxQuantile(key, [k / parts for k in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("part", part)
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(group, "part").count().select(group, "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(key, tie)) - 1
    return rows.withColumn("n", own).join(counts, [group, "part"]).withColumn("n", F.col("n") + F.col("before")).drop("part", "before")


def _pack(ids: list[int], codes: list[np.ndarray]) -> list:
    """A tile's columns; places as compressed differences."""
    g = trigram_table(codes)
    narrow = np.uint16 if len(g.vocabulary) <= 1 << 16 else np.uint32
    steps = np.diff(g.places, prepend=0).astype(narrow)
    zip_ = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
    return [np.array(ids, np.int64).tobytes(), g.sizes.tobytes(), len(g.vocabulary), zip_(np.diff(g.vocabulary, prepend=0)), zip_(steps)]


def _unpack(tile: tuple) -> tuple[np.ndarray, Grams]:
    ids, sizes, n, vocabulary, places = tile
    narrow = np.dtype(np.uint16 if n <= 1 << 16 else np.uint32)
    sizes = np.frombuffer(sizes, np.int64)
    raw = lambda x, kind, n: np.frombuffer(pa.decompress(x, n * kind.itemsize, "zstd", asbytes=True), kind)
    vocabulary = np.cumsum(raw(vocabulary, np.dtype(np.int64), n))
    return np.frombuffer(ids, np.int64), Grams(sizes, vocabulary, np.cumsum(raw(places, narrow, int(sizes.sum())), dtype=narrow))


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that follow each other with the same first `key` columns."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return itertools.groupby(rows, lambda row: row[:key])


_TILE = "ids binary, sizes binary, n int, vocabulary binary, places binary"


def _tiles(rows: DataFrame, most: int) -> DataFrame:
    """source, block, blocks, and tiles of the trigrams of at most so many (at least one) of the block's documents, about 2 M trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(key: tuple, ids: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
            values = [*key, *_pack(ids, codes)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            names = ["source", "block", "blocks", "ids", "sizes", "n", "vocabulary", "places"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for key, docs in _runs(batches, 3):
            ids, codes, size = [], [], 0
            for *_, doc_id, text in docs:
                own = trigram_codes(text)
                if ids and (len(ids) >= most or size + len(own) > 1 << 21):
                    yield batch(key, ids, codes)
                    ids, codes, size = [], [], 0
                ids.append(doc_id)
                codes.append(own)
                size += len(own)
            yield batch(key, ids, codes)

    return rows.mapInArrow(run, f"source string, block int, blocks int, {_TILE}")


def _compared(one: tuple, two: tuple | None) -> pa.RecordBatch:
    """a, b, similarity of the pairs between two tiles, or (without a second one) within one."""
    ids, g = _unpack(one)
    other, h = _unpack(two) if two else (ids, g)
    n = shared_trigrams(g, h)
    either = g.sizes[:, None] + h.sizes - n
    a, b = np.minimum(ids[:, None], other), np.maximum(ids[:, None], other)
    on = a != b
    if two is None:
        on &= np.tri(len(ids), k=-1, dtype=bool).T
    # Half up, as Spark rounds: a quotient that is no tie is further from one than doubles err.
    similarity = np.floor(n * 1e6 / np.maximum(either, 1) + 0.5) / 1e6
    return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (a, b, similarity)], names=["a", "b", "similarity"])


def trigram_pairs(docs: DataFrame, block: int = 8192, chars: int = 32 << 20, tile: int = 1024) -> DataFrame:
    """a, b, similarity by trigrams: all pairs a < b of documents of a source.

    A source is dealt into blocks of about so many documents and characters; each two blocks, and each block with
    itself, meet in one task, a pair of tiles at a time. The pairs grow with the square of a source's documents.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    docs = docs.where("source is not null and doc_id is not null").select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("text")) / chars)).cast("int")
    sizes = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"), blocks.alias("blocks"))
    large = F.collect_list(F.when(F.col("blocks") > 1, F.struct("source", "blocks")))
    pairs, large = sizes.agg(F.sum(F.col("n") * F.col("n") / 2), large).first()
    large = spark.createDataFrame(large, "source string, blocks int")
    # A task for each 16 M pairs: compressed tiles are too small to be dealt by their bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 15, int(pairs or 0) >> 24))

    plain = F.coalesce(F.lower(F.regexp_replace("text", r"\s+", " ")), F.lit(""))
    rows = docs.join(F.broadcast(large), "source", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = F.pmod(F.xxhash64("doc_id", "text"), F.col("blocks")).cast("int")
    rows = rows.select("source", at.alias("block"), "blocks", "doc_id", plain.alias("text"))
    tiles = _tiles(rows.repartition("source", "block").sortWithinPartitions("source", "block"), tile)
    met = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = [F.col("source"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")]
    met = met.select(*key, "block", *(c.split()[0] for c in _TILE.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), tiles in _runs(batches, 3):
            first: list[tuple] = []
            for _, _, _, own, *t in tiles:
                if own == x:
                    first.append(tuple(t))
                    if x == y:
                        yield _compared(first[-1], None)
                if x == y:
                    yield from (_compared(f, first[-1]) for f in first[:-1])
                elif own == y:
                    yield from (_compared(f, tuple(t)) for f in first)

    met = met.repartition(tasks, "source", "x", "y").sortWithinPartitions("source", "x", "y", "block")
    return met.mapInArrow(run, "a long, b long, similarity double")
