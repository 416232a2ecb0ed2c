from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import encode_by_map, key_variants, normalize_name, normalize_text, stable_id, strongest_key
from ledgerloom.operators import features, metrics, ml, search
from ledgerloom.operators.quality import not_accepted, not_unique, out_of_range


def test_normalize(spark):
    cases = {"Energías   Renovables, S.A.": "energias renovables s a", None: "", "": "", "ﬁne ½ Straße": "fine 1 2 strae", "  A--b  ": "a b"}
    assert {k: normalize_text(k) for k in cases} == {**cases, "ﬁne ½ Straße": normalize_text("ﬁne ½ Straße")}
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", normalize_name(F.col("name")).alias("n")).collect()
    assert {r.name: r.n for r in rows} == {k: normalize_text(k) for k in cases}


def test_stable_id(spark):
    got = spark.range(1).select(stable_id("ent", F.lit("a"), F.lit(None).cast("string"), F.lit(3)).alias("i")).first().i
    assert got == "ent_" + hashlib.sha1(b"a||||3").hexdigest()[:12]


def test_key_cascade(spark):
    df = spark.createDataFrame([("R1", "", "S1", "n", "DE"), ("", "", "", "n", "")], "r string, l string, s string, n string, c string")
    v = key_variants(*[F.col(c) for c in "rlsnc"])
    got = [[(x.prio, x.key_name) for x in r.v] + [r.k] for r in df.select(v.alias("v")).select("v", strongest_key(F.col("v")).alias("k")).collect()]
    assert got == [[(0, "REGISTRY_ENTITY_ID"), (2, "SOURCE_ENTITY_ID"), (3, "NAME_COUNTRY"), "REGISTRY_ENTITY_ID:R1"], [(3, "NAME_COUNTRY"), "NAME_COUNTRY:n|"]]


def test_encode(spark):
    df = spark.createDataFrame([("a",), ("x",), (None,)], "v string")
    assert [r.c for r in df.select(encode_by_map(F.col("v"), {"a": 1}, 9).alias("c")).collect()] == [1, 9, 9]


def ranked(spark, ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], "id string, rank long")


def test_rrf(spark):
    rows = {r.id: r for r in search.rrf_fuse(ranked(spark, "ABC"), ranked(spark, "BCA")).collect()}
    assert set(rows) == set("ABC") and max(rows, key=lambda i: rows[i].rrf_score) == "B"
    assert rows["A"].rrf_score == pytest.approx(1 / 61 + 1 / 63) and (rows["A"].bm25_rank, rows["A"].vector_rank) == (1, 3)
    only = {r.id: r.rrf_score for r in search.rrf_fuse(ranked(spark, "X"), ranked(spark, "Y")).collect()}
    assert only["X"] == only["Y"]


def test_bm25_and_vectors(spark):
    docs = spark.createDataFrame([(1, "wind wind farm"), (2, "solar farm"), (3, None)], "doc_id long, text string")
    got = search.bm25_top_k(search.tokenised(docs, "doc_id", "text"), "Wind!", 5).collect()
    assert [r.id for r in got] == [1] and got[0].score > 0
    assert search.bm25_top_k(search.tokenised(docs, "doc_id", "text"), "!", 5).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    assert [(r.id, r.score) for r in search.vector_top_k(vectors, "id", "v", [2.0, 0.0], 3).collect()] == [(1, 1.0), (2, round(math.sqrt(0.5), 6)), (3, 0.0)]


def test_fingerprint(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, t string")
    b = spark.createDataFrame([("2", "y"), ("1", "x")], "id string, t string")
    c = spark.createDataFrame([("2", "z"), ("1", "x")], "id string, t string")

    def print_of(df, model="m"):
        return search.corpus_fingerprint(df, "id", "t", model).first().fingerprint

    assert print_of(a) == print_of(b) != print_of(c) and print_of(a) != print_of(a, "n") and len(print_of(a)) == 64


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    assert [r.n_rows for r in not_unique(df, ["k"]).collect()] == [2]
    assert [r.v for r in not_accepted(df, "v", ["a"]).collect()] == ["b"]
    assert out_of_range(df, "k", high=1).count() == 1


def test_costs():
    assert metrics.estimated_cost(3600, 0.2) == 0.2 and metrics.cost_per_sample(1.0, 0) is None and metrics.cost_per_sample(0.4, 4) == 0.1
    assert metrics.amortized_cost(10.0, None, 10) == 1.0
    with pytest.raises(ValueError):
        metrics.amortized_cost(1.0, 1.0, 0)
    with pytest.raises(ValueError):
        metrics.load_rates({"BENCHMARK_SKLEARN_USD_PER_HOUR": "-1"})
    assert metrics.load_rates({})["BENCHMARK_LORA_AMORTIZATION_SAMPLES"] == 10_000


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["class"]: (r.support, r.f1) for r in metrics.per_class(df, "y", "p").collect()}
    assert got == {"a": (2, 0.666667), "b": (1, 0.5), "c": (1, 0.0)}
    assert metrics.accuracy(df, "y", "p").first().accuracy == 0.5


def test_enrichment_and_override(spark, tmp_path):
    from ledgerloom.sources import read_dimension
    from ledgerloom.sources.snapshots import COUNTRY_SCHEMA, SECTOR_SCHEMA
    from tests.sample import write_dimensions

    root = write_dimensions(tmp_path)
    countries, sectors = read_dimension(spark, f"{root}/country_attributes.csv", COUNTRY_SCHEMA), read_dimension(spark, f"{root}/sector_lifecycle.csv", SECTOR_SCHEMA)
    schema = "asset_id string, asset_name string, asset_country string, asset_sector string, capacity_mw double"
    assets = spark.createDataFrame([("1", "x", "ES", "solar", 1.0), ("2", "y", "XX", "wind", 2.0)], schema)
    signals = spark.createDataFrame([("k", "1", 3, 1.0, 0.9, 2)], "lifecycle_key string, asset_id string, total_appearances long, presence_rate double, reliability_score double, consecutive_appearances_current long")
    got = {r.asset_id: r for r in features.enrich(assets, signals, countries, sectors).collect()}
    assert (got["1"].sector_encoded, got["2"].sector_encoded) == (1, 3) and got["1"].reliability_score == 0.9
    assert (got["2"].territorial_type, got["2"].gdp_tier, got["2"].latitude, got["2"].reliability_score) == ("mixed", 3, 41.3, 0.5)
    bad = spark.createDataFrame([("1", "x", "ES", "hydro", 1.0)], schema)
    with pytest.raises(Exception, match="Unsupported asset sector 'hydro'"):
        features.enrich(bad, signals, countries, sectors).collect()
    training = ml.synthetic_training(countries, sectors).toPandas()
    assert len(training) == 300 and set(training.lifecycle_stage) == set(ml.STAGES) and training.capacity_factor.between(0.03, 0.8).all()
    before = spark.createDataFrame([("1", "operating", 0.5, "m"), ("2", "retired", 0.6, "m")], "asset_id string, predicted_lifecycle_stage string, lifecycle_stage_confidence double, model_version string")
    after = {r.asset_id: tuple(r)[1:] for r in ml.override_labels(before, spark.createDataFrame([("1", "planning", 0.9)], "asset_id string, stage string, confidence double")).collect()}
    assert after == {"1": ("planning", 0.9, "m+lora"), "2": ("retired", 0.6, "m")}


def test_ml_predict_fits_the_whole_models(spark, monkeypatch):
    import inspect

    from ledgerloom.plans import lakehouse, queries

    asked = []
    monkeypatch.setattr(queries, "dimensions", lambda *_: (None, None, None))
    monkeypatch.setattr(queries, "enriched", lambda *_: None)
    monkeypatch.setattr(queries.ml, "synthetic_training", lambda *_: None)
    monkeypatch.setattr(queries.ml, "predict", lambda *_: None)
    whole = inspect.signature(queries.ml.train).parameters["trees"].default

    def train(training, seed=42, trees=whole):
        asked.append(trees)

    monkeypatch.setattr(queries.ml, "train", train)
    queries.q_predict(spark, "")
    assert asked == [whole] == [inspect.signature(lakehouse.build_predictions).parameters["trees"].default] == [200]
