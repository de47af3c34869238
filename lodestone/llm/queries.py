"""The subpackage's queries for the driver, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, licences, mixing, ngram_join, pii, quality, sharding, substring_dedup
from .base import table


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, with_text=False, with_digests=True)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join_ngrams(table(spark, sf_dir, "documents"), n=4, least=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shard_rows(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.is_held_out()))
    return quality.score(docs, model).select(
        "doc_id", quality.is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_passages(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe_encoding": op1_bpe_encoding,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_syncmer_fingerprints": op9_syncmer_fingerprints,
    "op10_licence_scan": op10_licence_scan,
}
ORACLE_SQL = {
    "op8_mixing": mixing.MIX_SQL,
    "op10_licence_scan": licences.LICENCE_SQL,
}
