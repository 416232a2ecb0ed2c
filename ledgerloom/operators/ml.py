"""Lifecycle predictions with MLlib trees on synthetic training data."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import encode_by_map
from ledgerloom.operators.features import FEATURES, TERRITORIAL, TERRITORIAL_DEFAULT, sector_codes

# The stages, the year they refer to, and the version of the models.
STAGES = ("planning", "construction", "operating", "decommissioning", "retired")
REFERENCE_YEAR = 2025
MODEL_VERSION = "mllib-trees-1"
_SIZES = (35, 50, 90, 100, 120, 150, 200, 220, 300, 500)


def _uniform(row: Column, draw: str, seed: int) -> Column:
    """A number in [0, 1) from a row's number: the same in every run and for every partitioning."""
    return F.pmod(F.xxhash64(row, F.lit(draw), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _normal(row: Column, draw: str, seed: int) -> Column:
    u = F.greatest(_uniform(row, f"{draw} u", seed), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * _uniform(row, f"{draw} v", seed))


def synthetic_training(countries: DataFrame, sectors: DataFrame, n: int = 300, seed: int = 42) -> DataFrame:
    """Labelled assets: drawn by hash from the dimensions, labelled by age against lifespan."""
    spark = countries.sparkSession
    row = F.col("id")
    weighted = sector_codes(sectors).select(
        "*", F.sum(F.col("training_weight").cast("double")).over(_before("sector")).alias("upto"), F.sum(F.col("training_weight").cast("double")).over(_whole()).alias("total")
    )
    shares = weighted.select("*", (F.col("upto") / F.col("total")).alias("high"), ((F.col("upto") - F.col("training_weight").cast("double")) / F.col("total")).alias("low"))
    numbered = countries.select("*", (F.row_number().over(_order("country_code")) - 1).alias("country_no"), F.count("*").over(_whole()).alias("n_countries"))
    drawn = (
        spark.range(n)
        .withColumn("pick", _uniform(row, "sector", seed))
        .join(shares, (F.col("pick") >= F.col("low")) & (F.col("pick") < F.col("high")))
        .join(numbered, F.floor(_uniform(row, "country", seed) * F.col("n_countries")) == F.col("country_no"))
    )
    level = F.col("economic_level")
    bonus = F.lit(0.0)
    for name in ("high", "upper_middle", "lower_middle", "low"):
        bonus = F.when(level == name, F.col(f"economic_level_bonus_{name}").cast("double")).otherwise(bonus)
    altitude, lifespan = F.col("altitude_avg_m").cast("double"), F.col("typical_lifespan_years").cast("double")
    size = F.element_at(F.array(*[F.lit(float(s)) for s in _SIZES]), (F.floor(_uniform(row, "size", seed) * len(_SIZES)) + 1).cast("int"))
    years = F.greatest(
        F.col("min_lifespan_years").cast("double"),
        F.least(F.col("max_lifespan_years").cast("double"), lifespan + bonus * 5 + altitude * F.col("altitude_sensitivity") * 10 + 1.5 * _normal(row, "life", seed)),
    )
    built = drawn.withColumns(
        {
            "capacity_mw": F.greatest(F.lit(1.0), F.round(size * (1 + 0.05 * _normal(row, "capacity", seed)), 1)),
            "commissioning_year": (2000 + F.floor(_uniform(row, "year", seed) * 31)).cast("int"),
            "span": F.round(years).cast("int"),
        }
    ).withColumns({"retirement_year": F.col("commissioning_year") + F.col("span"), "age": F.lit(REFERENCE_YEAR) - F.col("commissioning_year")})
    observed = F.least(F.lit(3), F.greatest(F.lit(1), F.col("age")))
    seen = (1 + F.floor(_uniform(row, "seen", seed) * observed)).cast("long")
    presence = seen / observed
    reliability = F.least(F.lit(1.0), F.greatest(F.lit(0.1), presence * (0.8 + 0.2 * _uniform(row, "reliable", seed))))
    factor = (
        F.col("base_capacity_factor")
        + F.col("solar_irradiance_kwh_m2_yr") * F.col("irradiance_sensitivity")
        + F.col("wind_speed_avg_ms") * F.col("wind_sensitivity")
        + altitude * F.col("altitude_sensitivity")
        + bonus
        + 0.015 * _normal(row, "factor", seed)
    )
    stage = (
        F.when(F.col("age") < 0, "planning")
        .when(F.col("age") < F.col("construction_years"), "construction")
        .when(F.col("retirement_year") <= REFERENCE_YEAR, "retired")
        .when(F.col("age") >= F.col("span") - F.col("decommissioning_years"), "decommissioning")
        .otherwise("operating")
    )
    return built.select(
        "id",
        "capacity_mw",
        "sector_encoded",
        F.col("latitude_centroid").cast("double").alias("latitude"),
        F.col("longitude_centroid").cast("double").alias("longitude"),
        altitude.alias("altitude_avg_m"),
        encode_by_map(F.col("territorial_type"), TERRITORIAL, TERRITORIAL_DEFAULT).alias("territorial_type_encoded"),
        F.col("gdp_tier").cast("long").alias("gdp_tier"),
        F.col("solar_irradiance_kwh_m2_yr").cast("double").alias("solar_irradiance_kwh_m2_yr"),
        F.col("wind_speed_avg_ms").cast("double").alias("wind_speed_avg_ms"),
        F.col("regulatory_stability_score").cast("double").alias("regulatory_stability_score"),
        seen.alias("total_appearances"),
        F.round(presence, 3).alias("presence_rate"),
        F.round(reliability, 3).alias("reliability_score"),
        lifespan.alias("typical_lifespan_years"),
        stage.alias("lifecycle_stage"),
        "retirement_year",
        F.round(F.least(F.lit(0.8), F.greatest(F.lit(0.03), factor)), 4).alias("capacity_factor"),
        "commissioning_year",
    )


def _order(column: str):
    return Window.orderBy(column)


def _before(column: str):
    return Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)


def _whole():
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def train(training: DataFrame, seed: int = 42, trees: int = 200):
    """A classifier of stages and two regressors behind one assembler, as fitted pipeline models."""
    training = training.repartition(1).cache()  # a few hundred rows: one task, and the same trees in every run
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    index = StringIndexer(inputCol="lifecycle_stage", outputCol="stage_index", stringOrderType="alphabetAsc")
    stage = RandomForestClassifier(labelCol="stage_index", numTrees=trees, maxDepth=8, minInstancesPerNode=3, seed=seed)
    retirement = GBTRegressor(labelCol="retirement_year", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=seed)
    factor = RandomForestRegressor(labelCol="capacity_factor", numTrees=trees, maxDepth=6, minInstancesPerNode=3, featureSubsetStrategy="all", seed=seed)
    models = {
        "stage": Pipeline(stages=[assembler, index, stage]).fit(training),
        "retirement": Pipeline(stages=[assembler, retirement]).fit(training),
        "factor": Pipeline(stages=[assembler, factor]).fit(training),
    }
    training.unpersist()
    return models


def predict(assets: DataFrame, models: dict) -> DataFrame:
    """Predictions within their plausible ranges, one row per enriched asset."""
    labels = models["stage"].stages[1].labels
    assembler, forest = models["stage"].stages[0], models["stage"].stages[2]
    scored = forest.transform(assembler.transform(assets)).select("*", vector_to_array("probability").alias("p")).drop("rawPrediction", "probability", "prediction")
    for name in ("retirement", "factor"):
        scored = models[name].stages[1].transform(scored).withColumnRenamed("prediction", f"raw_{name}")
    best = F.array_max("p")
    retired = F.least(F.lit(2080), F.greatest(F.lit(2025), F.col("raw_retirement"))).cast("long")
    return scored.select(
        "asset_id", "asset_name", "asset_country", "asset_sector", "capacity_mw", "latitude", "longitude", "altitude_avg_m", "territorial_type",
        "economic_level", "gdp_tier", "solar_irradiance_kwh_m2_yr", "wind_speed_avg_ms", "regulatory_stability_score", "typical_lifespan_years",
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position("p", best).cast("int")).alias("predicted_lifecycle_stage"),
        F.bround(best, 4).alias("lifecycle_stage_confidence"),
        retired.alias("estimated_retirement_year"),
        (retired - F.col("typical_lifespan_years").cast("long")).alias("estimated_commissioning_year"),
        F.greatest(F.lit(0.0), (retired - REFERENCE_YEAR).cast("double")).alias("predicted_remaining_years"),
        F.bround(F.least(F.lit(80.0), F.greatest(F.lit(1.0), F.col("raw_factor") * 100)), 2).alias("predicted_capacity_factor_pct"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )


def override_labels(predictions: DataFrame, overrides: DataFrame, suffix: str = "+lora") -> DataFrame:
    """Put in another model's stage and confidence where it has them; other rows stay as they are."""
    better = overrides.select(F.col("asset_id").alias("o_id"), F.col("stage").alias("o_stage"), F.col("confidence").alias("o_confidence"))
    joined = predictions.join(better, F.col("asset_id") == F.col("o_id"), "left")
    has = F.col("o_stage").isNotNull()
    return joined.withColumns(
        {
            "predicted_lifecycle_stage": F.coalesce("o_stage", "predicted_lifecycle_stage"),
            "lifecycle_stage_confidence": F.when(has, F.col("o_confidence")).otherwise(F.col("lifecycle_stage_confidence")),
            "model_version": F.when(has, F.concat("model_version", F.lit(suffix))).otherwise(F.col("model_version")),
        }
    ).drop("o_id", "o_stage", "o_confidence")
