"""A corpus pipeline over ``documents``: five stages, each the whole input of the next.

1. quality: documents that the classifier scores under 0.7 go. It is fitted on
   the labelled documents of ``sf_dir`` (at most 2,500, see the classifier).
2. near_duplicates: of each group of documents linked by shared 5-word shingles
   (Jaccard 0.8 or more) the one with the smallest id stays.
3. personal_data: e-mail and IP addresses, card and phone numbers are replaced
   by their kind in brackets.
4. mixing: sources are drawn to their target weights; a document appears as
   often as it is drawn, or not at all.
5. tokens: doc_id, n_tokens and the BPE ids of the text, once for each time that
   the mix drew it.

All stages but the last return the columns of ``documents``. No stage can be
said whole in SQL (a fitted classifier, a fitted random field, a tokenizer), so
there is no ORACLE_SQL; the tests hold the stages against plain versions.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, ngram_join, pii, quality
from lodestone.llm.base import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, ngram_join.join_ngrams(docs, n=5, least=(8, 10)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_text=False)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda df, stage: stored(stage[1](spark, df, sf_dir)), STAGES, docs)
