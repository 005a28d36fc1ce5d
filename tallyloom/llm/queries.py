"""Queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.staging import new_path
from tallyloom.llm import (centroids, chat, licenses, linerules, mixing, pieces, pii, quality, simhash, toxicity,
                           vectors, warc, whitening)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, folder, "labels")))


def op2_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.with_probe(table(spark, folder, "conversations"))
    return chat.digests(chat.examples(turns))


def op5_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scores(docs, model)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op9_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return linerules.verdicts(table(spark, folder, "documents")).drop("cleaned")


def op10_sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.token_digests(table(spark, folder, "documents"), model)


def op11_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """deviation is null where it does not fit a long; the operator has it as a decimal."""
    rows = whitening.whitened(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_report(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_source_mixture": op2_source_mixture,
    "op3_warc_segments": op3_warc_segments,
    "op4_chat_examples": op4_chat_examples,
    "op5_simhash_duplicates": op5_simhash_duplicates,
    "op6_embedding_duplicates": op6_embedding_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_line_rules": op9_line_rules,
    "op10_sentencepiece_round_trip": op10_sentencepiece_round_trip,
    "op11_bootstrapped_pii": op11_bootstrapped_pii,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = {
    "op2_source_mixture": mixing.MIXTURE_SQL,
    "op3_warc_segments": warc.ROUND_TRIP_SQL,
    "op4_chat_examples": chat.DIGESTS_SQL,
    "op6_embedding_duplicates": vectors.DUPLICATES_SQL,
    "op8_license_scan": licenses.SCAN_SQL,
    "op9_line_rules": linerules.VERDICTS_SQL,
    "op13_centroids": centroids.CLUSTERS_SQL,
}
