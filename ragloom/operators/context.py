"""Rerank, budgeted context, sources, confidence, grounding; and the edges where models plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Characters of context, and the room below which nothing more is tried.
BUDGET, ROOM = 14000, 100


def _with(df: DataFrame, **more: ST.DataType) -> ST.StructType:
    """df's schema and further columns; adding to df.schema itself would change what df says its columns are."""
    return ST.StructType([*df.schema.fields, *(ST.StructField(k, t) for k, t in more.items())])


def rerank(candidates: DataFrame, score: str, first: int = 50, query_id: str = "query_id") -> DataFrame:
    """new_rank: the first ones by an injected score (missing: last), the tail behind them in its order."""
    key = F.when(F.col("rank") <= first, F.coalesce(F.col(score), F.lit(-1.0))).otherwise(-2.0)
    return candidates.withColumn("new_rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(key), "rank")).cast("long"))


def score_pairs(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], cut: int = 1500) -> DataFrame:
    """A column rerank_score from an injected batch scorer of (question, chunk) pairs."""
    schema = _with(candidates, rerank_score=ST.DoubleType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(rerank_score=scorer(list(b["question"]), [t[:cut] for t in b["text"].fillna("")]))

    return candidates.mapInPandas(run, schema)


def fit(chunks: list[tuple[str, bool, str]], budget: int = BUDGET) -> str:
    """Chunks (text, is a table, section) in order until the budget is full; only prose is cut, at a sentence or a space."""
    out, left = [], budget
    for text, table, section in chunks:
        if left <= ROOM:
            break
        label = f"[{section}]\n" if section and not text.startswith(f"[{section}]") else ""
        piece = label + text
        if len(piece) > left:
            if table:
                continue
            head = piece[:left]
            cut = max(head.rfind(". "), head.rfind("\n"), head.rfind("? "))
            if cut > left // 2:
                piece = head[: cut + 1]
            elif (cut := head.rfind(" ")) > left // 2:
                piece = head[:cut]
            else:
                continue
        out.append(piece)
        left -= len(piece) + 2
    return "\n\n".join(out)


def build_context(picked: DataFrame, budget: int = BUDGET, query_id: str = "query_id", order: str = "score") -> DataFrame:
    """query_id, context, n_chars of at most `budget`: a fold over one question's few picks."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([order, "chunk_id"], ascending=[order != "score", True])
        text = fit(list(zip(g["text"].fillna(""), g["content_type"] == "table", g["section_header"].fillna(""), strict=True)), budget)
        return pd.DataFrame({query_id: [key[0]], "context": [text], "n_chars": [len(text)]})

    return picked.groupBy(query_id).applyInPandas(run, f"{query_id} long, context string, n_chars long")


def sources(candidates: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, file_name, score, first_rank: a file's best score, in order of first appearance."""
    return candidates.groupBy(query_id, "file_name").agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"))


def confidence(best: Column) -> Column:
    """Null for no score; else what lies above a half, doubled, within 0 and 1, to hundredths."""
    return F.when(best > 0, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best - 0.5) / 0.5)) * 100 + 0.5) / 100)


def ground(verdicts: list[tuple[str, Column]]) -> Column:
    """The first validator that rejects, else 'accepted'; a missing verdict passes."""
    out = F.lit("accepted")
    for name, ok in reversed(verdicts):
        out = F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def embed(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 32) -> DataFrame:
    """A column embedding from an injected batch embedder."""
    schema = _with(df, embedding=ST.ArrayType(ST.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b[text].fillna(""))
            yield b.assign(embedding=[v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])])

    return df.mapInPandas(run, schema)


def hashing_embedder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A deterministic stand-in: signed hashed words, unit length."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h >> 31 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def generate(prompts: DataFrame, generator: Callable[[str], str], prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """answer and error from an injected generator; it is asked again on errors that pass, not on a spent quota."""
    schema = _with(prompts, answer=ST.StringType(), error=ST.StringType())

    def one(p: str) -> tuple[str | None, str | None]:
        last = None
        for _ in range(retries + 1):
            try:
                return generator(p), None
            except Exception as e:  # noqa: BLE001  an injected service may raise anything
                last = str(e)
                if any(s in last.lower() for s in ("429", "resource_exhausted", "quota exceeded")):
                    break
        return None, last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(p) for p in b[prompt]]
            yield b.assign(answer=[g[0] for g in got], error=[g[1] for g in got])

    return prompts.mapInPandas(run, schema)
