"""A stored search index over current entities: postings, lengths, vectors and attributes as Parquet.

``build`` projects the entities, compares the corpus's fingerprint with that of the stored index and
writes only when they differ. A query reads the postings of its own tokens; they are sorted by token, so
the filter skips the other row groups.

An embedder is any function from a series of texts to a series of vectors, called by executors in Arrow batches.
:func:`hashed_embedding` needs no model; a learned encoder takes its place by the same signature.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import search
from ledgerloom.shared import path_exists, shared_path

Embedder = Callable[[pd.Series], pd.Series]
#: Attributes of an entity that the text and the results are made of.
ATTRIBUTES = ("entity_id", "entity_name", "normalized_name", "country_code", "entity_type", "lei")
DIMENSIONS = 384


def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Unit vectors of hashed three-character pieces."""

    def one(text: str | None) -> list[float]:
        out = np.zeros(DIMENSIONS)
        padded = f" {(text or '').lower()} "
        for i in range(len(padded) - 2):
            code = zlib.crc32(padded[i : i + 3].encode())
            out[code % DIMENSIONS] += 1.0 if code & 0x80000000 else -1.0
        length = float(np.sqrt((out * out).sum()))
        return (out / length if length else out).tolist()

    return texts.map(one)


def current_entities(entities: DataFrame) -> DataFrame:
    """The attributes that search reads, and ``text``."""
    text = search.search_text(*[F.col(c) for c in ATTRIBUTES[1:]])
    return entities.select(*ATTRIBUTES, text.alias("text"))


def embedded(corpus: DataFrame, embed: Embedder) -> DataFrame:
    """(id, vector) of a corpus (entity_id, text)."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["entity_id"], "vector": embed(batch["text"])})

    return corpus.select("entity_id", "text").mapInPandas(run, "id string, vector array<double>")


class EntityIndex:
    """Reads one stored index."""

    def __init__(self, spark: SparkSession, folder: str, embed: Embedder = hashed_embedding):
        self.spark, self.folder, self.embed = spark, folder, embed

    def table(self, name: str) -> DataFrame:
        version = self.spark.read.parquet(f"{self.folder}/fingerprint").first().version
        return self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def keyword(self, query: str, k: int) -> DataFrame:
        words = search.query_words(query)
        found = self.table("postings").filter(F.col("token").isin(words))
        df = found.groupBy("token").agg(F.count("*").alias("df"))
        weight = search.bm25_weight(*[F.col(c) for c in ("tf", "df", "dl", "n_docs", "avgdl")])
        # df and totals have one row for each query word, and one row
        scored = found.join(F.broadcast(df), "token").crossJoin(F.broadcast(self.table("totals"))).groupBy("id").agg(F.sum(weight).alias("score"))
        return search.top_k(scored.filter("score > 0"), k)

    def nearest(self, query: str, k: int) -> DataFrame:
        return search.vector_top_k(self.table("vectors"), "id", "vector", self.embed(pd.Series([query])).iloc[0], k)

    def search(self, query: str, k: int = 5) -> DataFrame:
        """The best k entities by both lists, with ranks, scores and attributes; a blank lei is null."""
        wide = search.candidate_count(k)
        attributes = self.table("attributes").withColumnRenamed("entity_id", "id").withColumn("lei", F.nullif("lei", F.lit("")))
        best = search.hybrid(self.keyword(query, wide), self.nearest(query, wide), attributes, k)
        return best.withColumnRenamed("id", "entity_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), "entity_id")


def build(entities: DataFrame, folder: str | None = None, embed: Embedder = hashed_embedding, model: str = "hashed-384") -> tuple[EntityIndex, bool]:
    """The index of ``entities`` in ``folder``, and whether it had to be written anew.

    Versions have folders of their own; the fingerprint table, written last, names the one that readers open.
    """
    spark = entities.sparkSession
    folder = folder or shared_path(spark, "entity-index")
    corpus = current_entities(entities)
    wanted = search.corpus_fingerprint(corpus, "entity_id", "text", model).first().fingerprint
    if path_exists(spark, f"{folder}/fingerprint") and spark.read.parquet(f"{folder}/fingerprint").first().fingerprint == wanted:
        return EntityIndex(spark, folder, embed), False
    version = f"version-{wanted[:16]}"
    root = f"{folder}/{version}"
    split = search.tokenised(corpus, "entity_id", "text").select("id", F.size("tokens").cast("long").alias("dl"), "tokens")
    postings = split.select("id", "dl", F.explode("tokens").alias("token")).groupBy("token", "id", "dl").agg(F.count("*").alias("tf"))
    postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{root}/postings")
    split.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{root}/totals")
    embedded(corpus, embed).write.mode("overwrite").parquet(f"{root}/vectors")
    corpus.drop("text").write.mode("overwrite").parquet(f"{root}/attributes")
    spark.createDataFrame([(wanted, version, model)], "fingerprint string, version string, model string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/fingerprint")
    return EntityIndex(spark, folder, embed), True
