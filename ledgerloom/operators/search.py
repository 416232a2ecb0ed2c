"""Keyword search, vector search and their fusion.

Tokens are runs of two or more of ``[0-9a-z_]`` in lower-cased text. A query over a plain corpus counts its own
tokens in one pass over the texts; a stored index (:mod:`ledgerloom.operators.entity_index`) reads only
their postings. Both end in a top-k, so no list of all scores is sorted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import join_non_blank
from ledgerloom.shared import materialize

K1, B = 1.5, 0.75
RRF_K = 60
TOKEN = r"[0-9a-z_]{2,}"


def search_text(name: Column, normalized: Column, country: Column, kind: Column, lei: Column) -> Column:
    """The text that both indexes read."""
    return join_non_blank(" ", name, normalized, country, kind, lei)


def corpus_fingerprint(corpus: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """One digest of ids, texts and model, the same in whatever order rows come.

    Row digests are summed in eight parts of 32 bits, so nothing is gathered.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col(text_col)), 256)
    digests = corpus.select(F.explode(F.array(digest)).alias("digest"))  # computed once for all parts
    parts = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    sums = digests.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("|", F.lit(model), "n", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(8)]), 256).alias("fingerprint"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_words(query: str) -> list[str]:
    return sorted(set(re.findall(TOKEN, query.lower())))


def tokenised(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens). The tokens come out of a generator, so that no later expression splits a text again."""
    return corpus.select(F.col(id_col).alias("id"), F.explode(F.array(tokens(F.col(text_col)))).alias("tokens"))


def bm25_weight(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column) -> Column:
    """One token's share of a document's score."""
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _times(word: str) -> Column:
    return F.size(F.filter("tokens", lambda token: token == F.lit(word))).cast("long")


def bm25_scores(corpus: DataFrame, query: str) -> DataFrame:
    """(id, score) of the documents of ``corpus`` (:func:`tokenised`) that hold a query token.

    The query's tokens are counted inside each document's array in one pass, and the narrow counts are
    written before the corpus's totals and the scores are taken from them.
    """
    words = query_words(query)
    if not words:
        return corpus.select("id", F.lit(0.0).alias("score")).limit(0)
    counts = [_times(word).alias(f"tf{i}") for i, word in enumerate(words)]
    counted = materialize(corpus.select("id", F.size("tokens").cast("long").alias("dl"), *counts), "term-counts")
    times = [F.col(f"tf{i}") for i in range(len(words))]
    totals = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.sum((tf > 0).cast("long")).alias(f"df{i}") for i, tf in enumerate(times)])
    score = F.lit(0.0)
    for i, tf in enumerate(times):
        score = score + F.when(tf > 0, bm25_weight(tf, F.col(f"df{i}"), F.col("dl"), F.col("n_docs"), F.col("avgdl"))).otherwise(0.0)
    return counted.filter(F.greatest(F.lit(0), *times) > 0).crossJoin(F.broadcast(totals)).select("id", score.alias("score"))  # one row of totals


def top_k(scores: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """The best k by rounded score, ties to the smaller id, with ranks from 1."""
    best = scores.select("id", F.round("score", decimals).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def bm25_top_k(corpus: DataFrame, query: str, k: int) -> DataFrame:
    return top_k(bm25_scores(corpus, query).filter("score > 0"), k)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = sum(x * x for x in query) ** 0.5
    return F.when(norm * length > 0, dot / (norm * length)).otherwise(0.0)


def vector_top_k(vectors: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest by cosine; an empty query finds nothing."""
    if not len(query):
        return top_k(vectors.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0), k)
    return top_k(vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score")), k)


def rrf_fuse(keyword: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: id, rrf_score and both ranks, order of ties as in the lists."""
    left = keyword.select("id", F.col("rank").alias("bm25_rank"))
    right = vector.select("id", F.col("rank").alias("vector_rank"))
    both = left.join(right, "id", "full_outer")
    score = F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0))
    return both.withColumn("rrf_score", score)


def hybrid(keyword: DataFrame, vector: DataFrame, attributes: DataFrame, k: int) -> DataFrame:
    """The best k of the fused lists with their attributes joined."""
    order = [F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), F.asc("id")]
    best = rrf_fuse(keyword, vector).withColumn("rrf_score", F.round("rrf_score", 6)).orderBy(*order).limit(k)
    return best.join(attributes, "id", "left")


def candidate_count(k: int) -> int:
    return max(4 * k, 20)
