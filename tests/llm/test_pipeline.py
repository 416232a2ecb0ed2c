from __future__ import annotations

import corpus_pipeline
from tests.llm.cases import documents, labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rows = [r[:5] for r in documents(120)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(r[0], r[1]) for r in rows if r[0] is None or r[0] % 2]).selectExpr("doc_id", "1 as quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append((name, docs.count()))
    assert [n for n, _ in sizes] == ["language_id", "quality_knn", "near_dedup", "mix", "byte_bpe"]
    assert sizes[0][1] >= 120 and sizes[2][1] < sizes[1][1] and sizes[3][1] == sizes[4][1]


def test_whole_run(spark, tmp_path):
    rows = [r[:5] for r in documents(45)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(45)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 40 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
