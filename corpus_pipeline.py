"""Corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages and
benchmark passages are cut out, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and is written as
Parquet before the next one reads it. All stages but the last return the columns of ``docs``;
``n_chars`` follows the text where a stage changes it (only where the table has that column).
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlane.llm import bpe, decontaminate, ngram_join, substring, toxicity
from pactlane.llm.blocks import scratch, table
from pactlane.session import ship

TOXIC_FROM = 0.5
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
PASSAGE_WORDS = 20
BENCHMARK_WORDS = 10


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


OWN = ("doc_id", "text", "n_chars")  # columns that stages read; the others get plain names while a stage runs


def _stage(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        inner = [c if c in OWN else f"extra_{k}_" for k, c in enumerate(docs.columns)]
        back = dict(zip(inner, docs.columns, strict=True))
        out = fn(spark, docs.toDF(*inner), sf_dir)
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


@_stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; the model learns from these documents and ``labels``.
    Null and empty texts stay, repeated rows stay or go together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("__score") < TOXIC_FROM).select(*docs.columns)


@_stage
def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard from 0.8): the one with
    the smallest id. Documents without words are no copies of one another and all stay."""
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_WORDS`` words or more that stand earlier are cut out; no row goes."""
    return _counted(substring.deduplicate(docs, PASSAGE_WORDS), docs)


@_stage
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly benchmark go."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS), docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document left; a null text has no ids."""
    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_join", keep_one_near_copy),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("bpe", encode),
]

# The classifier, the components and the merge rules are beyond SQL; tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
