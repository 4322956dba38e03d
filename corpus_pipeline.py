"""From raw documents to token ids: five stages, each on all that the one before kept.

language identification -> one document of each near-duplicate group -> secrets taken out ->
sources mixed to their weights -> byte-level BPE.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import bpe, jaccard_join, langid, mixing, secrets
from loomwell.runtime import free_name, materialize, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without letters and ambiguous ones go."""
    ship(spark)
    model = langid.train(docs.where("doc_id IS NOT NULL"))
    names = told, _, ambiguous = tuple(free_name(docs, c) for c in ("_told_language", "_told_score", "_told_ambiguous"))
    return langid.identify(docs, model, out=names).where((F.col(told) != langid.UNKNOWN) & ~F.col(ambiguous)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars set anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each row, whole texts, with the decoded bytes' digest."""
    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "lang", "source", "text")
    ids = bpe.encode(rows, path, pattern, digest="text_sha256").drop("text")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text_sha256")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the first stage nor the last; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
