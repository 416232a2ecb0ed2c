"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes every stage's result to the
shared folder and reads it back as the next one's input. All but the last return the columns of
``documents``.

1. language_id: documents whose language can't be told with enough confidence go.
2. quality_knn: documents that the classifier, fitted on ``labels``, rejects go.
3. near_dedup: one document of each class of near-duplicates stays.
4. mix: sources are repeated or thinned to their target weights.
5. byte_bpe: texts are encoded, and decoded again as a proof.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, language_id, mixing, order_minhash, quality_knn
from ledgerloom.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores below it are rejected.
QUALITY_THRESHOLD = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit_languages(docs)
    return language_id.identify(docs.select(*COLUMNS), model).filter("accepted").select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_knn.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.classify(docs.select(*COLUMNS), model).filter(F.col("quality_score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs.select(*COLUMNS), order_minhash.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(docs, keep=("text", "lang", "n_chars"))
    repeated = mixing.repeat_documents(planned)
    return repeated.select(F.col("mix_id").alias("doc_id"), "text", "lang", F.col("mix_source").alias("source"), "n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_and_digest(docs, ranks, public_tokenizers.PATTERN, keep=("lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("quality_knn", filter_quality),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the classifiers, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
