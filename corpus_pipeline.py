"""From raw documents to token ids: toxicity, quality rules, near duplicates, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.staging import stage
from tallyloom.llm import linerules, mixing, pieces, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, fitted on the labels, does not predict toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted_documents(docs, toxicity.fit(docs, labels))


def with_clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return linerules.cleaned_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.kept_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row a document."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.token_digests(docs, model)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("quality rules", with_clean_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("mixing sources", mixed),
    ("sentencepiece", encoded),
]

#: The classifier, the fingerprints and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
