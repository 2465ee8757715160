"""Many questions against a corpus at once: exact vector top-k, keyword ranking, reciprocal rank fusion.

Questions come in blocks of a bounded size, which are broadcast; each task
scores its rows against a block and keeps its own best, so that only k rows for
each question and task meet in the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Questions of a block.
BLOCK = 4096


def _blocks(rows: DataFrame, *cols: str) -> Iterator[pd.DataFrame]:
    held: list = []
    for r in rows.select(*cols).toLocalIterator():
        held.append(tuple(r))
        if len(held) == BLOCK:
            yield pd.DataFrame(held, columns=list(cols))
            held = []
    if held:
        yield pd.DataFrame(held, columns=list(cols))


def best(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = 300, least: float = 0.5, chunk_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, rank, chunk_id, score: the k nearest by cosine, in double precision, of at least `least`."""
    spark, out = chunks.sparkSession, None
    schema = f"{query_id} long, {chunk_id} long, score double"
    for q in _blocks(queries, query_id, vector):
        m = np.stack([np.asarray(v, float) for v in q[vector]])
        shared = spark.sparkContext.broadcast((q[query_id].to_numpy(), m / np.linalg.norm(m, axis=1, keepdims=True)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, unit = shared.value
            for b in batches:
                b = b[b[vector].notna()]
                if not len(b):
                    continue
                x = np.stack(b[vector].to_numpy()).astype(float)
                s = np.round(unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                cid = b[chunk_id].to_numpy()
                for i in range(len(ids)):
                    at = np.flatnonzero(s[i] >= least)
                    at = at[np.lexsort((cid[at], -s[i][at]))][:k]
                    yield pd.DataFrame({query_id: ids[i], chunk_id: cid[at], "score": s[i][at]})

        part = chunks.select(chunk_id, vector).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{schema}, rank long")
    return best(out, query_id, k, F.desc("score"), F.col(chunk_id))


def vector_fallback(scored: DataFrame, least: float = 0.5, floor: float = 0.35, step: float = 0.1, enough: int = 5, query_id: str = "query_id") -> DataFrame:
    """Rows scored once down to the lower threshold; a question with too few hits takes those of the lower one."""
    w = Window.partitionBy(query_id)
    hits = scored.withColumn("hits", F.count_if(F.col("score") >= least).over(w))
    lower = max(floor, least - step)
    return hits.where(F.col("score") >= F.when(F.col("hits") < enough, lower).otherwise(least)).withColumn("retried", F.col("hits") < enough).drop("hits")


def keyword_hits(chunks: DataFrame, queries: DataFrame, k: int = 100, chunk_id: str = "doc_id", text: str = "text", query_id: str = "query_id") -> DataFrame:
    """query_id, rank, chunk_id, hits: chunks that contain most of a question's keywords. queries has an array column keywords.

    All keywords of a block of questions are looked for in one pass over a text.
    """
    spark, out = chunks.sparkSession, None
    schema = f"{query_id} long, {chunk_id} long, hits long"
    for q in _blocks(queries, query_id, "keywords"):
        by: dict[str, list[int]] = {}
        for i, words in zip(q[query_id], q["keywords"], strict=True):
            for w in words:
                by.setdefault(w, []).append(int(i))
        shared = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            by = shared.value
            find = _finder(list(by))
            for b in batches:
                rows: dict[int, list] = {}
                for cid, t in zip(b[chunk_id], b[text], strict=True):
                    n: dict[int, int] = {}
                    for w in find((t or "").lower()):
                        for i in by[w]:
                            n[i] = n.get(i, 0) + 1
                    for i, c in n.items():
                        rows.setdefault(i, []).append((-c, cid))
                for i, found in rows.items():
                    found = sorted(found)[:k]
                    yield pd.DataFrame({query_id: i, chunk_id: [c for _, c in found], "hits": [-n for n, _ in found]})

        part = chunks.select(chunk_id, text).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{schema}, rank long")
    return best(out, query_id, k, F.desc("hits"), F.col(chunk_id))


def _finder(words: list[str]):
    """A function from a text to the set of words it contains."""
    try:
        import ahocorasick
    except ImportError:
        return lambda t: {w for w in words if w in t}
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    if not words:
        return lambda t: set()
    a.make_automaton()
    return lambda t: {w for _, w in a.iter(t)}


def postings(chunks: DataFrame, chunk_id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, tf) of light-stemmed words: the table to keep, partitioned by term, for repeated searches.

    terms: for one search, the rows of `query_terms`; other words leave before the shuffle.
    """
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    rows = chunks.select(chunk_id, F.explode(words).alias("term")).select(chunk_id, T.stem(F.col("term")).alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", chunk_id).agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """A row for each distinct stemmed keyword of a question."""
    return queries.select(query_id, F.explode(F.array_distinct(F.transform("keywords", T.stem))).alias("term"))


def keyword_rank(post: DataFrame, queries: DataFrame, k: int = 100, chunk_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """query_id, rank, chunk_id, score: sum of term frequencies over a question's stemmed keywords, by an equi join on the term."""
    hits = post.join(query_terms(queries, query_id), "term").groupBy(query_id, chunk_id).agg(F.sum("tf").alias("score"))
    return best(hits, query_id, k, F.desc("score"), F.col(chunk_id))


def pseudo_score(rank: Column) -> Column:
    """What a keyword hit of a rank (from 1) counts beside vector scores."""
    return F.greatest(F.lit(0.40), F.lit(0.99) - F.lit(0.01) * (rank - 1))


def fuse(vector: DataFrame, lexical: DataFrame, key: str, k: int = 60, cap: int = 100, query_id: str = "query_id") -> DataFrame:
    """query_id, key, score, best_rank, in_vector: sum of 1 / (k + rank) over both lists' first `cap`; one shuffle."""
    part = lambda df, v: df.where(F.col("rank") <= cap).select(query_id, key, "rank", F.lit(v).alias("v"))
    both = part(vector, 1).unionByName(part(lexical, 0))
    one = F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))
    # Each list has a key once; summed in a fixed order, vector first.
    v, x = F.max(F.when(F.col("v") == 1, one)), F.max(F.when(F.col("v") == 0, one))
    return both.groupBy(query_id, key).agg((F.coalesce(v, F.lit(0.0)) + F.coalesce(x, F.lit(0.0))).alias("score"), F.min("rank").alias("best_rank"), (F.max("v") == 1).alias("in_vector"))


def boost_tables(fused: DataFrame, is_list: Column, is_table: Column, boost: float = 0.08) -> DataFrame:
    return fused.withColumn("score", F.col("score") + F.when(is_list & is_table, boost).otherwise(0.0))
