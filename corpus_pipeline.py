"""From documents to token ids: five stages, each written as Parquet and read again by whoever runs them.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import bpe, decontam, langid, neardup, pii, util

#: A document whose predicted language is surer than this is kept; four languages give 0.25 by chance.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language is a toss-up."""
    lang, score = (util.fresh(c, docs.columns) for c in ("lang_pred", "score"))
    out = langid.predict(docs, langid.fit(docs), (lang, score))
    return out.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word-shingle sets of similarity 0.8 or more, the document with the smallest id stays, once.

    Of rows that repeat its id that with the least text stays, then that with the least other columns as JSON.
    """
    kept = neardup.near_duplicates(docs, words=5, num=80, den=100).where("kept")
    stay = kept.where("doc_id is not null").select("doc_id").distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    row = F.min_by(F.struct(*cols), F.struct("text", others)).alias("row")
    once = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*")
    return once.select(*cols).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind."""
    return pii.mask(docs, pii.fit(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express a trained model, a sketch or the merges; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = util.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
